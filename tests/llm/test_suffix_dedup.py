import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from civicspark.llm.suffix_dedup import anchors, remove_repeats
from civicspark.llm.suffix_sort import Contexts, _exact, neighbours, repeats, sort_rows


def slow(texts, length):
    """texts: bytes -> removed runs of each."""
    starts = defaultdict(list)
    for i, t in enumerate(texts):
        for a in range(len(t) - length + 1):
            starts[t[a : a + length]].append((i, a))
    gone = [bytearray(len(t)) for t in texts]
    for at in starts.values():
        if len(at) > 1:
            for i, a in at:
                gone[i][a : a + length] = b"\x01" * length
    out = []
    for g in gone:
        edge = np.flatnonzero(np.diff(np.r_[0, np.frombuffer(bytes(g), dtype=np.uint8).astype(int), 0]))
        out.append([(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])])
    return out


def check(rows, got, length):
    texts = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), t, gone in zip(rows, texts, slow(texts, length)):
        kept = bytes(x for k, x in enumerate(t) if not any(a <= k < b for a, b in gone))
        want.append((i, len(t), gone, hashlib.sha256(kept).hexdigest()))
    assert sorted(((r[0], r.n_bytes, [tuple(s) for s in r.spans], r.kept_sha256) for r in got), key=str) == sorted(want, key=str)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize("seed", range(8))
def test_suffix_sort_against_plain_sorts(seed):
    rng = np.random.default_rng(seed)
    n, at, width, length = 70, 8, 20, 12
    bucket, left = rng.integers(0, 4, n), rng.integers(0, at + 1, n)
    strings = [bytes(rng.choice([97, 98], p=[0.93, 0.07], size=a + rng.integers(1, width - at + 1)).astype(np.uint8)) for a in left]
    c = Contexts(strings, left, bucket, at, width)
    for forward in (True, False):
        key = lambda i: (bucket[i], strings[i][left[i] :] if forward else strings[i][: left[i]][::-1], i)  # noqa: B023, E731
        assert sort_rows(c, forward).tolist() == sorted(range(n), key=key)
    low, high = repeats(c, length)
    for b in range(4):
        rows = np.flatnonzero(bucket == b)
        want = _exact(c, rows, length)
        assert (low[rows] == want[0]).all() and (high[rows] == want[1]).all()


def test_colliding_hashes_are_caught(monkeypatch):
    from civicspark.llm import suffix_sort

    monkeypatch.setattr(suffix_sort, "LETTER", np.ones(257, dtype=np.uint64))
    rng = np.random.default_rng(1)
    strings = [bytes(rng.integers(97, 123, 20).astype(np.uint8)) for _ in range(30)] + [b"x" * 20] * 2
    c = Contexts(strings, np.full(32, 8), np.zeros(32, dtype=np.int64), 8, 20)
    low, high = repeats(c, 12)
    assert low.tolist() == [-1] * 30 + [0, 0] and high.tolist() == [-1] * 30 + [8, 8]


def test_misordered_rows_are_caught(monkeypatch):
    """Two letters of one hash: the sort takes different rows for equal and their order is wrong in places."""
    from civicspark.llm import suffix_sort

    letters = suffix_sort.LETTER.copy()
    letters[98] = letters[97]
    monkeypatch.setattr(suffix_sort, "LETTER", letters)
    rng = np.random.default_rng(5)
    strings = [bytes(rng.choice([97, 98, 99], size=20, p=[0.1, 0.1, 0.8]).astype(np.uint8)) for _ in range(300)]
    bucket = rng.integers(0, 5, 300)
    c = Contexts(strings, np.full(300, 8), bucket, 8, 20)
    assert len(neighbours(c, sort_rows(c, True), True)[1])
    low, high = repeats(c, 12)
    for b in range(5):
        rows = np.flatnonzero(bucket == b)
        want = _exact(c, rows, 12)
        assert (low[rows] == want[0]).all() and (high[rows] == want[1]).all()


@pytest.mark.parametrize("text", [b"ab" * 900, b"a" * 1500, bytes(range(256)) * 6, b"x" * 399, b""])
def test_every_string_has_an_anchor(text):
    at, _ = anchors(text, 400)
    for a in range(len(text) - 399):
        assert ((at >= a) & (at + 64 <= a + 400)).any()


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    check([tuple(r) for r in docs.collect()], remove_repeats(docs).collect(), 400)


@pytest.mark.parametrize("crowd", [8_192, 3])
def test_edge_cases(spark, crowd):
    rnd = random.Random(9)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghijé") for _ in range(rnd.randint(1, 9))) for _ in range(n))
    a, b = words(120), words(90)
    rows = [(1, a), (2, words(30) + b + words(40)), (3, b + a[:399]), (4, a[1:]), (5, None), (6, ""), (None, words(20) + b[:300] + words(3) + b[20:]), (7, "ab" * 3000), (8, "xyz " * 99)]
    rows += [(10 + k, words(9) + b + words(9)) for k in range(8)] + [(30, words(400)), (30, words(400)), (31, a), (31, a), (32, "long text " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_bytes", "2 as spans")
    check(rows, remove_repeats(docs, crowd=crowd).collect(), 400)
    assert remove_repeats(docs.limit(0)).count() == 0


def test_crowded_buckets_are_split_and_sorted(spark, monkeypatch):
    """One passage with other bytes around it each time: its bucket is far over the limit, and every sort stays under it."""
    from civicspark.llm import suffix_dedup

    rnd = random.Random(12)
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(n))
    passage = words(70)
    heads, tails = [words(25) for _ in range(6)], [words(25) for _ in range(6)]
    rows = [(k, rnd.choice(heads)[rnd.randint(0, 90) :] + passage[rnd.randint(0, 60) : len(passage) - rnd.randint(0, 60)] + rnd.choice(tails)) for k in range(60)]
    rows += [(60 + k, words(5) + passage + words(5)) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = []
    real = suffix_dedup._split_crowds

    def noted(contexts, *rest):
        out = real(contexts, *rest)
        parts.extend(p.groupBy("anchor").count().agg({"count": "max"}).first()[0] or 0 for p in out[0])
        return out

    monkeypatch.setattr(suffix_dedup, "_split_crowds", noted)
    check(rows, remove_repeats(docs, crowd=6).collect(), 400)
    assert 3 < len(parts) <= 11 and max(parts) <= 6
