import math
import struct
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from civicspark.llm.common import salt
from civicspark.llm.mixing import BLOCK, mix, mixed, pivotal_round, source_targets


def slow_targets(sizes, weights=(5, 2, 1)):
    names = sorted((x for x in sizes if x is not None), key=lambda x: [ord(c) for c in x]) + [None] * (None in sizes)
    w = {x: weights[i % 3] for i, x in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        share = {x: left * w[x] / sum(w[y] for y in free) for x in free}
        full = {x for x in free if share[x] >= 2 * sizes[x]}
        if not full:
            return target | share
        target |= {x: 2.0 * sizes[x] for x in full}
        left -= sum(target[x] for x in full)
        free -= full
        if not free:
            return target


def check(spark, docs):
    got = mix(docs).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    source = {r.doc_id: r.source for r in docs.collect()}
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got:
        assert r["size"] == len([x for x in text[r.doc_id].replace("\x0b", " ").replace("\x0c", " ").split() if x])
        sizes[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    want = slow_targets(sizes)
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]], rel=1e-12)
    return want, taken, got


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    want, taken, got = check(spark, docs)
    assert sum(taken.values()) == pytest.approx(sum(want.values()), rel=0.03)
    again = mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_rounding_keeps_sums_and_expectations(spark):
    rows = spark.range(3000).select(F.lit("g").alias("group"), "id", (F.col("id") % 97 + 50).alias("size"), F.lit(0.37).alias("p"))
    seen = defaultdict(int)
    for seed in range(6):
        got = pivotal_round(rows, seed).collect()
        assert len(got) == 3000 and len({r.id for r in got}) == 3000
        assert abs(sum(r.take for r in got) - 1110) <= 1
        assert sum(r.take * r["size"] for r in got) == pytest.approx(0.37 * sum(r["size"] for r in got), rel=0.005)
        for r in got:
            seen[r.id] += r.take
    assert len(set(seen.values())) > 3  # draws of different seeds differ


def test_edge_cases(spark):
    rows = [(1, "a b c", "x", 9), (1, "a b c", "x", 9), (2, None, "x", 9), (None, "d e", None, 9), (4, "", "é", 9), (5, "word " * 30_000, "y", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mix(docs).collect()
    assert len(got) == 6 and {r["size"] for r in got} == {3, 0, 2, 30_000}
    assert all(r.taken == 0 for r in got if r["size"] == 0)
    assert len({r.taken for r in got if r.doc_id == 1}) == 1
    assert mix(docs.limit(0)).count() == 0
    out = mixed(docs)
    assert out.columns == docs.columns
    assert out.where("doc_id = 5").count() == next(r.copies for r in got if r.doc_id == 5)
    only_empty = mix(docs.where("coalesce(text, '') = ''")).collect()
    assert [(r.target, r.taken) for r in only_empty] == [(0.0, 0)] * 2


def spark_hash(*values):
    """Spark's xxhash64 of integers (4 bytes) and longs (8 bytes, given as pairs)."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v[0]) if isinstance(v, tuple) else struct.pack("<i", v), seed=h)
    return h - (1 << 64) if h >> 63 else h


def slow_round(rows, seed, block=BLOCK):
    """rows: [(group, id, size, p)] -> {(group, id, size): take}, one document after the other on each level of the tree."""
    uniform = lambda *v: spark_hash(seed, *[(x,) for x in v]) % (1 << 52) / (1 << 52)
    take = {(g, i, n): 0 for g, i, n, p in rows if p < 1e-12}
    left = [(g, math.floor(4 * math.log2(n + 1)), i, n, p) for g, i, n, p in rows if p >= 1e-12]
    level = 0
    while True:
        crowd, counts = defaultdict(int), defaultdict(int)
        for g, c, *_ in left:
            counts[g, c] += 1
            crowd[g] += 1
        if level and all(n <= block for n in counts.values()) and all(n == 1 for n in crowd.values()):
            break
        blocks = defaultdict(list)
        for g, c, i, n, p in left:
            blocks[g, c, spark_hash(seed + level, (i,), (n,)) % -(-counts[g, c] // block)].append((n, spark_hash(seed, (i,)), i, p))
        left = []
        for (g, _, _), members in blocks.items():
            carry = None
            for n, _, i, p in sorted(members):
                if carry is None:
                    carry = (i, n, p)
                    continue
                ci, cn, cp = carry
                total, u = cp + p, uniform(ci, cn, i, n)
                if abs(total - 1) < 1e-12:
                    take[g, i, n], take[g, ci, cn], carry = int(u < p), int(u >= p), None
                elif total < 1:
                    if u * total < p:
                        take[g, ci, cn], carry = 0, (i, n, total)
                    else:
                        take[g, i, n], carry = 0, (ci, cn, total)
                elif u * (2 - total) < 1 - p:
                    take[g, ci, cn], carry = 1, (i, n, total - 1)
                else:
                    take[g, i, n], carry = 1, (ci, cn, total - 1)
            if carry:
                left.append((g, 0, *carry))
        level += 1
    for g, _, i, n, p in left:
        take[g, i, n] = int(uniform(i, n) < p)
    return take


@pytest.mark.parametrize("seed", [0, 5])
def test_rounding_against_a_plain_one(spark, seed):
    import random

    rnd = random.Random(seed)
    rows = [(rnd.choice(("a", "a", "a", "b", None)), k, rnd.choice((1, 5, 5, 70, 71, 900)), rnd.choice((0.0, 0.25, 0.5, 0.75, rnd.random()))) for k in range(2500)]
    rows += [("c", 9000, 3, 0.4)]
    got = pivotal_round(spark.createDataFrame(rows, "group string, id long, size long, p double"), seed).collect()
    assert {(r.group, r.id, r["size"]): r["take"] for r in got} == slow_round(rows, seed)


def test_targets_of_many_sources(spark):
    import random

    rnd = random.Random(4)
    sizes = {f"s{rnd.random()}{'é' * (k % 2)}": rnd.choice((0, 1, 10, 1000, 100_000)) for k in range(700)} | {None: 50, "\U0001f600": 7, "\uffff": 9}
    rows = spark.createDataFrame([(g, n, k) for k, (g, n) in enumerate(sizes.items())], "g string, size long, id long").withColumn("salt", salt("id"))
    got = {r.g: r.target for r in source_targets(rows.repartition(9), "g", "size").collect()}
    assert got == pytest.approx(slow_targets(sizes), rel=1e-12)


def test_very_long_texts(spark):
    """A text of a million words among short ones: sizes are those of whole texts and targets are met by copies of what there is."""
    rows = [(0, "word " * 1_000_000, "a")] + [(i, "w " * (i % 50 + 1), "ab"[i % 2]) for i in range(1, 400)]
    got = {r.doc_id: r for r in mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].size == 1_000_000 and got[0].taken in (0, 1_000_000, 2_000_000) and all(r.taken <= 2 * r.size for r in got.values())
    goals = slow_targets({s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "ab"})
    assert all(r.target == pytest.approx(goals["a" if i == 0 or i % 2 == 0 else "b"]) for i, r in got.items())
