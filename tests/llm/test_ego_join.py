import numpy as np
import pytest

from civicspark.llm import ego_join
from civicspark.llm.ego_join import near_vectors


def slow(rows, cosine=0.95):
    """rows: [(id, vector)] -> {id: (links, smallest id reachable)}"""
    ok = {}
    for i, v in rows:
        if v is not None and None not in v and np.isfinite(v).all() and any(v):
            ok[i] = np.array(v, dtype=np.float64)
    near = {i: {i} for i, _ in rows}
    for i, a in ok.items():
        for j, b in ok.items():
            if i != j and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= cosine:
                near[i].add(j)
    low = {i: i for i in near}
    for _ in near:
        new = {i: min(low[j] for j in near[i]) for i in near}
        if new == low:
            break
        low = new
    return {i: (len(near[i]) - 1, low[i]) for i in near}


def result(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("cells,leaf", [(1 << 20, 512), (60 * 24, 16)])
def test_clusters(spark, monkeypatch, cells, leaf):
    monkeypatch.setattr(ego_join, "LEAF", leaf)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(500, 24)).astype(np.float32)
    v[100:300] = v[rng.integers(0, 20, 200)] + rng.normal(size=(200, 24)) * 0.22  # near the threshold
    v[300:380] = v[300] + rng.normal(size=(80, 24)) * 0.02  # a crowd
    v[380:420] = v[7]  # copies
    v[420] = 3 * v[7]
    rows = [(int(i) * 3, x.tolist()) for i, x in zip(rng.permutation(500), v)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), cells=cells)
    want = slow(rows)
    assert sum(n for n, _ in want.values()) > 6000
    assert result(got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())


def test_edge_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1e-200, 0.0]), (11, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "5 as rep", "6 as n")
    want = {i: (0, i) for i, _ in rows}
    want |= {1: (2, 1), 2: (2, 1), 10: (2, 1)}
    assert result(near_vectors(df)) == want
    assert near_vectors(df.limit(0)).count() == 0
    again = near_vectors(spark.createDataFrame([(1, [1.0]), (1, [1.0]), (None, [1.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in again) == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True)]


def test_ids_and_dimensions(spark):
    with pytest.raises(TypeError):
        near_vectors(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<float>"))
    rng = np.random.default_rng(6)
    v = rng.normal(size=(40, 5000)).astype(np.float32)
    v[20:] = v[:20] * 2
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    assert result(near_vectors(spark.createDataFrame(rows, "vec_id int, embedding array<float>"))) == slow(rows)
