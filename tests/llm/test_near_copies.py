import random
import re
from itertools import combinations

import numpy as np
import pytest

from civicspark.llm.near_copies import candidate_links, one_of_each_group, similar_sets
from tests.llm.test_simhash import slow_fingerprint


def slow_set(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def slow_groups(sets, similarity=0.8):
    """{id: set} -> {id: smallest id reachable}, by all pairs."""
    group = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or len(x & y) >= similarity * len(x | y) - 1e-9:
            low, high = sorted((group[a], group[b]))
            group = {i: low if g == high else g for i, g in group.items()}
    return group


@pytest.mark.parametrize("n", [1, 40, 200])
def test_similar_sets_against_all_pairs(n):
    rnd = random.Random(n)
    seeds = [rnd.sample(range(3000), rnd.randint(1, 60)) for _ in range(max(1, n // 8))]
    sets = {}
    for i in range(n):
        s = set(rnd.choice(seeds))
        for _ in range(rnd.randint(0, 8)):
            s ^= {rnd.randrange(3000)}
        sets[i] = s or {1}
    got = similar_sets([np.array(sorted(sets[i]), dtype=np.uint64) for i in range(n)], 0.8)
    want = slow_groups(sets)
    assert got.tolist() == [want[i] for i in range(n)]


@pytest.mark.parametrize("piece", [65_536, 40])
def test_candidates_are_all_pairs_in_the_radius(spark, piece):
    rng = np.random.default_rng(5)
    fps = np.repeat(rng.integers(0, 2**63, size=30, dtype=np.uint64), 4)
    for _ in range(9):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, len(fps)).astype(np.uint64))
    sizes = rng.integers(80, 120, len(fps))
    nodes = spark.createDataFrame([(i, [int(f.view(np.int64))], int(s)) for i, (f, s) in enumerate(zip(fps, sizes))], "__set long, __fps array<long>, __size int")
    tree = {i: i for i in range(len(fps))}
    links = [(r.a, r.b) for r in candidate_links(nodes, 12, 0.8, piece).collect()]
    want = [(a, b) for a, b in combinations(range(len(fps)), 2) if (int(fps[a]) ^ int(fps[b])).bit_count() <= 12 and min(sizes[a], sizes[b]) >= 0.8 * max(sizes[a], sizes[b])]
    assert len(want) > 5
    for pairs in (links, want):
        tree = {i: i for i in range(len(fps))}
        for a, b in pairs:
            low, high = sorted((tree[a], tree[b]))
            tree = {i: low if g == high else g for i, g in tree.items()}
        got, tree_of = (tree, None) if pairs is links else (got, tree)
    assert got == tree_of


def test_near_copies_beyond_two_bits_go(spark):
    """Copies with some words exchanged: nearly all of them differ in more than the two bits of the op5 query."""
    rnd = random.Random(8)
    rows = []
    for i in range(40):
        w = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        rows.append((2 * i, " ".join(w)))
        for k in (30, 90, 150)[: 1 + i % 3]:
            w[k] = "Other"
        rows.append((2 * i + 1, " ".join(w)))
    rows += [(100, "a b c"), (101, "A b  C"), (102, "a b d"), (103, ""), (104, None), (None, "one two three four five six"), (105, "one two three four five six")]
    texts = {-1 if i is None else i: t for i, t in rows}
    want = slow_groups({i: slow_set(t) for i, t in texts.items()})
    far = [i for i in range(0, 80, 2) if (slow_fingerprint(texts[i]) ^ slow_fingerprint(texts[i + 1])).bit_count() > 2]
    assert len(far) > 20 and all(want[i + 1] == i for i in far)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(-1 if r.doc_id is None else r.doc_id for r in one_of_each_group(docs).collect())
    assert got == sorted(set(want.values()))
    assert one_of_each_group(docs.limit(0)).count() == 0


@pytest.mark.parametrize("limits", [{"texts": 2}, {"most": 300}])
def test_groups_of_many_or_long_texts_are_compared_in_parts(spark, limits):
    """One candidate group, of which one text is longer than a part may be: the parts change no result."""
    rnd = random.Random(3)
    w = [f"w{k}" for k in range(400)]
    texts = {i: " ".join(w[: 200 + i % 3] + [f"x{i}"] * (i % 2)) for i in range(12)} | {20: " ".join(w), 21: " ".join(w[1:]), 22: " ".join(rnd.sample(w, 300))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = sorted(set(slow_groups({i: slow_set(t) for i, t in texts.items()}).values()))
    assert sorted(r.doc_id for r in one_of_each_group(docs, **limits).collect()) == want
