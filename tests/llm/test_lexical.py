"""Ranked search against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from civicspark.llm.lexical import K2Treap, LexicalIndex, Top
from civicspark.llm.queries import ORACLES, op11_lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, ids string, terms string, item long"
ITEMS = "item_id long, text string, item string, doc_id string, rank int"


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    bags = [(i, Counter(split(t))) for i, t in docs if split(t)]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    holders = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            m = 10 + (90 * sum(bag.values()) * n_docs) // total
            score = 0
            for t in set(split(text)):
                if t in bag:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is not None, i or 0))
        out += [(item, r + 1, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, k=10, **kw):
    docs = spark.createDataFrame([(*d, "x", None, 3) for d in docs], DOCS)
    items = spark.createDataFrame([(*i, "y", None, 1) for i in items], ITEMS)
    return sorted(map(tuple, LexicalIndex.build(docs, **kw).search(items, k).collect()), key=str)


def tables(seed, n):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Über", "ÜBER", "Ab", "aB", "naïve", "日本", "x_y", "a1"]
    word = lambda: vocab[min(int(rnd.expovariate(0.12)), len(vocab) - 1)]
    text = lambda m: rnd.choice([" ", ", ", "\n", "_"]).join(word() for _ in range(rnd.randrange(m)))
    docs = [(rnd.choice([i, i, i, None, rnd.randrange(-5, 9)]), rnd.choice([None, "", "...", *[text(60)] * 9])) for i in range(n)]
    docs += [(1000 + i, "w3 w4 the same text") for i in range(n // 2)]
    return docs, [(rnd.choice([i, i, None]), rnd.choice([None, "?", *[text(12)] * 8])) for i in range(40)]


@pytest.mark.parametrize("n,docs_each", [(3, 8192), (60, 7), (400, 8192), (400, 50)])
def test_against_every_document(spark, n, docs_each):
    docs, items = tables(n, n)
    assert run(spark, docs, items, segment_docs=docs_each) == plain(docs, items)


def test_fewer_and_more_results(spark):
    docs, items = tables(2, 80)
    assert run(spark, docs, items, k=1) == plain(docs, items, 1)
    assert run(spark, docs, items, k=1000) == plain(docs, items, 1000)


def test_empty_tables_and_unknown_terms(spark):
    docs, items = tables(3, 20)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None), (2, "")], items) == []
    assert run(spark, docs, [(1, "none of these words"[:4] + "zzz")]) == []


def test_ties_go_by_id_whatever_the_segments(spark):
    docs = [(i, "one two three") for i in range(200, 0, -1)] + [(None, "one two three"), (7, "one two three")]
    got = run(spark, docs + [(900 + i, "other words") for i in range(300)], [(1, "three")], segment_docs=9)
    assert sorted((r[1], r[2]) for r in got) == [(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 6), (8, 7), (9, 7), (10, 8)]


def test_very_long_text_and_item(spark):
    docs, items = tables(4, 30)
    docs.append((5000, " ".join(f"t{i % 70_000}" for i in range(300_000))))
    items.append((77, " ".join(f"t{i}" for i in range(5_000))))
    assert run(spark, docs, items) == plain(docs, items)


def test_treap_against_a_matrix_and_its_bytes():
    rnd = np.random.default_rng(3)
    for size, points in ((2, 1), (5, 9), (100, 700), (300, 20_000)):
        at = np.unique(rnd.integers(0, size * size, points))
        rows, cols, values = at // size, at % size, rnd.integers(1, 50, len(at))
        grid = np.zeros((size, size), dtype=np.int64)
        grid[rows, cols] = values
        treap = K2Treap.loads(K2Treap.of(rows, cols, values, size).dumps())
        for _ in range(20):
            asked = np.unique(rnd.integers(0, size, 6))
            weights, top = rnd.integers(1, 5, len(asked)), Top(4)
            treap.best(asked, weights, np.arange(size) * 2, top)
            scores = weights @ grid[asked]
            assert top.found == sorted((-int(s), 2 * i) for i, s in enumerate(scores) if s > 0)[:4]


def test_search_leaves_most_ranges():
    """A rare term decides: the cells of the documents without it are never opened."""
    size, rows, cols, values = 4096, [], [], []
    for d in range(size):
        rows += [0, 1 + d % 3000]
        cols += [d, d]
        values += [10, 10]
    treap, opened = K2Treap.of(np.array(rows), np.array(cols), np.array(values), size), 0
    place = Top.may_enter

    class Counted(Top):
        def may_enter(self, scores, ids):
            nonlocal opened
            opened += len(scores)
            return place(self, scores, ids)

    top = Counted(1)
    treap.best(np.array([0, 500]), np.array([1, 100]), np.arange(size), top)
    assert top.found == [(-1010, 499)] and opened < size // 4


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(ORACLES["op11_lexical_search"]).fetchall()
    assert want and sorted(map(tuple, op11_lexical_search(spark, folder).collect())) == sorted(want)
