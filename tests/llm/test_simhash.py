import random
import re

import numpy as np
import pytest
import xxhash

from civicspark.llm.bitsliced import link_buckets
from civicspark.llm.simhash import fingerprint, fingerprint_links, simhash_components

DATA = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(items, radius):
    """items: [(id, fp)] -> {id: smallest id reachable}"""
    group = {i: i for i, _ in items}
    changed = True
    while changed:
        changed = False
        for i, a in items:
            for j, b in items:
                if bin(a ^ b).count("1") <= radius and group[i] > group[j]:
                    group[i], changed = group[j], True
    return group


@pytest.mark.parametrize("text", ["", " \t\n", "one", "one Two", "A b\x0bC d e f", "Éa É b c", "x " * 5000])
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("n,radius", [(1, 2), (2, 0), (130, 2), (400, 3), (300, 1)])
def test_buckets_against_all_pairs(n, radius):
    rng = np.random.default_rng(n)
    fps = rng.integers(0, 2**63, size=max(1, n // 10), dtype=np.uint64)[rng.integers(0, max(1, n // 10), n)]
    for _ in range(3):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    bucket = np.sort(rng.integers(0, 3, n))
    got = link_buckets(bucket, fps, radius)
    want = {}
    for b in range(3):
        want |= slow_groups([(i, int(fps[i])) for i in np.flatnonzero(bucket == b)], radius)
    assert got.tolist() == [want[i] for i in range(n)]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in simhash_components(docs).collect()}
    fps = {r.doc_id: slow_fingerprint(r.text) for r in docs.collect()}
    assert {k: r.fingerprint & (2**64 - 1) for k, r in rows.items()} == fps
    assert {k: r.component_id for k, r in rows.items()} == slow_groups(list(fps.items()), 2)


def test_large_bucket_in_pieces(spark):
    fps = [(1 << i) | (1 << j) for i in range(12) for j in range(i)] + [0, 2**63, 2**63 + 2**40 + 2**20]
    table = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "__fp long")
    links = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in fingerprint_links(table, 2, piece=7).collect()]
    assert all(bin(a ^ b).count("1") <= 12 for a, b in links)
    tree = {x: x for x in fps}
    for _ in fps:
        for a, b in links:
            tree[a] = tree[b] = min(tree[a], tree[b])
    assert tree == slow_groups([(x, x) for x in fps], 2)


def test_edge_cases(spark):
    text = "the quick brown fox jumps over the lazy dog"
    rows = [(5, text, 1), (3, text.upper(), 2), (None, text, 3), (7, None, 4), (8, "", 5), (9, "alone here now", 6), (9, "alone here now", 7), (None, "by itself only", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash_components(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (None, 3), (7, 7), (8, 7), (9, 9), (9, 9), (None, None)], key=str)
    assert simhash_components(docs.limit(0)).count() == 0


def test_very_long_texts(spark):
    rnd = random.Random(11)
    words = [f"w{rnd.randrange(50_000)}" for _ in range(150_000)]
    other = [*words[:-1], "last"]
    rows = [(4, " ".join(words)), (2, "\n".join(other)), (9, "x" * 1_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint & (2**64 - 1), r.component_id) for r in simhash_components(docs).collect()}
    fps = {i: slow_fingerprint(t) for i, t in rows}
    assert {i: f for i, (f, _) in got.items()} == fps
    assert {i: c for i, (_, c) in got.items()} == slow_groups(list(fps.items()), 2) and got[4][1] == 2
