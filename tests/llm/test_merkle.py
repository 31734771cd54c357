"""The manifest against a plain tree in Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from civicspark.llm.merkle import manifest
from civicspark.llm.queries import ORACLES, op13_merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, path string, `group` string, idx long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, source, lang, n, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def tree(hashes, arity):
    """The root and each leaf's list of (before, after)."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for k, place in enumerate(at):
            lo = place // arity * arity
            paths[k].append(("".join(level[lo:place]), "".join(level[place + 1 : lo + arity])))
        level = [h(*level[i : i + arity]) for i in range(0, len(level), arity)]
        at = [place // arity for place in at]
    return level[0], paths


def plain(rows, arity=8):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {}
    for g in order:
        members = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r[0], r[3], r[2], r[4], r[1])))
        leaves = [leaf(r[0], r[3], r[2], r[4], r[1]) for r in members]
        subs[g] = (members, leaves, *tree(leaves, arity))
    if not order:
        return []
    root, upper = tree([subs[g][2] for g in order], arity)
    out = []
    for k, g in enumerate(order):
        members, leaves, sub, paths = subs[g]
        for r, own, path in zip(members, leaves, paths):
            whole = path + upper[k]
            proof = h(*[b + a for b, a in whole])
            given = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
                given = leaf(r[0], r[3], r[2], r[4], low)
            for b, a in whole:
                given = h(b, given, a)
            out.append((r[0], own, sub, root, proof, given, given == root))
    return sorted(out, key=str)


@pytest.fixture
def write(spark, tmp_path):
    def to(rows):
        spark.createDataFrame([(*r, "x", None, "g", 5) for r in rows], SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return to


def rows_of(n, seed):
    rnd = random.Random(seed)
    langs = [None, "", "de", "en", "en", "en", "é", "zz", "Z", *[f"l{i}" for i in range(12)]]
    texts = ["", None, "Ab", "ÀB c", "no capitals", "x" * 50]
    return [(rnd.choice([i, i, i, rnd.randrange(20), None]), rnd.choice(texts), rnd.choice(langs), rnd.choice([None, "s", "S1"]), rnd.choice([None, 3])) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 65, 700])
def test_query_against_a_plain_tree(spark, write, n):
    rows = rows_of(n, n)
    got = sorted(map(tuple, op13_merkle_manifest(spark, write(rows)).collect()), key=str)
    assert got == plain(rows)


def test_one_large_group_and_repeats(spark, write):
    rows = [(i, "T", "en", "s", 1) for i in range(513)] + [(7, "T", "en", "s", 1)] * 20 + [(3, "long " * 200_000, None, None, None)]
    got = sorted(map(tuple, op13_merkle_manifest(spark, write(rows)).collect()), key=str)
    assert got == plain(rows)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("arity", [2, 3])
def test_other_arities(spark, write, arity):
    rows = rows_of(60, 5)
    docs = spark.read.parquet(f"{write(rows)}/documents.parquet")
    path = F.transform("path", lambda s: F.concat(s.before, s.after))
    got = manifest(docs, arity=arity).select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(path, ""), 256), F.col("tampered_leaf").isNull())
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(*r[:5], True) for r in plain(rows, arity)], key=str)


def test_against_sql(spark, write):
    import duckdb

    folder = write(rows_of(300, 9))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    want = con.execute(ORACLES["op13_merkle_manifest"]).fetchall()
    assert sorted(want, key=str) == sorted(map(tuple, op13_merkle_manifest(spark, folder).collect()), key=str)
