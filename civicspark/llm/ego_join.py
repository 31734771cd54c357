"""Embedding near-duplicates by an epsilon grid order join on leading principal dimensions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from civicspark.llm.bitsliced import merge
from civicspark.llm.common import join_back, shared_table
from civicspark.llm.components import components

#: Vectors that the principal dimensions are fitted on. They decide speed, never a result.
BASIS_ROWS = 4096
#: Components of the vectors of one interval of the grid order, and vectors of a block in which all pairs are compared.
INTERVAL_CELLS, LEAF = 1 << 22, 512
#: Leading dimensions of the order key, with CELL_BITS each, and of the bounding boxes.
KEY_DIMS, CELL_BITS, BOX_DIMS = 10, 4, 16
#: Room for rounding of single-precision bounds.
SLACK = 1e-4
#: Linked pairs that a task holds before it joins their trees.
HOLD = 1 << 20


def usable(vec: Column) -> Column:
    """Not null, with components, all of them finite and one not zero at least."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that no square over- or underflows."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Basis:
    """An orthonormal basis, the directions of most spread first, and the grid on it."""

    def __init__(self, sample: np.ndarray, cosine: float):
        self.axes = np.linalg.svd(sample - sample.mean(axis=0), full_matrices=True)[2].T
        self.epsilon = math.sqrt(max(0.0, 2 - 2 * cosine))
        self.width = max(self.epsilon, 2 / (1 << CELL_BITS) * 1.0001)

    def head(self, units: np.ndarray) -> np.ndarray:
        return units @ self.axes[:, :BOX_DIMS]

    def cells(self, head: np.ndarray) -> np.ndarray:
        """Grid order: the cells of the leading dimensions as one number that sorts lexicographically."""
        cell = np.clip((head[:, :KEY_DIMS] + 1) / self.width, 0, (1 << CELL_BITS) - 1).astype(np.int64)
        key = np.zeros(len(head), dtype=np.int64)
        for k in range(cell.shape[1]):
            key = key << CELL_BITS | cell[:, k]
        return key


def box_gap(low_a, high_a, low_b, high_b):
    """Square of the least distance between boxes."""
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return (gap * gap).sum(axis=-1)


class Interval:
    """Vectors of one interval in grid order."""

    def __init__(self, units: np.ndarray, weights: np.ndarray, basis: Basis, first: int):
        self.units, self.weights, self.first = units, weights, first
        self.head = basis.head(units)
        tail = np.sqrt(np.maximum(0, 1 - (self.head * self.head).sum(axis=1)))
        self.bound = np.column_stack([self.head, tail]).astype(np.float32)
        self.links = np.zeros(len(units), dtype=np.int64)


class Join:
    """Recursive join of two intervals: provably distant parts are skipped, the rest is halved down to blocks."""

    def __init__(self, cosine: float, epsilon: float, size: int):
        self.cosine, self.reach = cosine, (epsilon + SLACK) ** 2
        self.parent = np.arange(size)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_held = 0

    def run(self, a: Interval, b: Interval, a0: int, a1: int, b0: int, b1: int) -> None:
        same = a is b and a0 == b0
        if a0 == a1 or b0 == b1:
            return
        if not same:
            x, y = a.head[a0:a1], b.head[b0:b1]
            if box_gap(x.min(axis=0), x.max(axis=0), y.min(axis=0), y.max(axis=0)) > self.reach:
                return
        if max(a1 - a0, b1 - b0) <= LEAF:
            self.leaf(a, b, a0, a1, b0, b1, same)
        elif same:
            m = (a0 + a1) // 2
            self.run(a, b, a0, m, a0, m)
            self.run(a, b, a0, m, m, a1)
            self.run(a, b, m, a1, m, a1)
        elif a1 - a0 >= b1 - b0:
            m = (a0 + a1) // 2
            self.run(a, b, a0, m, b0, b1)
            self.run(a, b, m, a1, b0, b1)
        else:
            m = (b0 + b1) // 2
            self.run(a, b, a0, a1, b0, m)
            self.run(a, b, a0, a1, m, b1)

    def leaf(self, a: Interval, b: Interval, a0: int, a1: int, b0: int, b1: int, same: bool) -> None:
        # leading dimensions bound the cosine: what is left adds the product of the two rests at most
        i, j = np.nonzero(a.bound[a0:a1] @ b.bound[b0:b1].T >= self.cosine - SLACK)
        if same:
            i, j = i[i < j], j[i < j]
        if not len(i):
            return
        i, j = i + a0, j + b0
        for lo in range(0, len(i), 1 << 16):
            p, q = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
            close = np.einsum("ij,ij->i", a.units[p], b.units[q]) >= self.cosine
            p, q = p[close], q[close]
            np.add.at(a.links, p, b.weights[q])
            np.add.at(b.links, q, a.weights[p])
            self.held.append((p + a.first, q + b.first))
            self.n_held += len(p)
        if self.n_held > HOLD:
            self.settle()

    def settle(self) -> None:
        if self.held:
            merge(self.parent, *(np.concatenate(x) for x in zip(*self.held)))
        self.held, self.n_held = [], 0


def _join_intervals(basis: Basis, cosine: float, dtype: str):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["piece", "key", "rep"], kind="stable")
        units = unit(np.frombuffer(b"".join(rows["vec"]), dtype=dtype).reshape(len(rows), -1))
        weights, cut = rows["n"].to_numpy(), int((rows["piece"] == key[0]).sum())
        a = Interval(units[:cut], weights[:cut], basis, 0)
        b = a if key[0] == key[1] else Interval(units[cut:], weights[cut:], basis, cut)
        join = Join(cosine, basis.epsilon, len(rows))
        join.run(a, b, 0, len(a.units), 0, len(b.units))
        join.settle()
        links = a.links if a is b else np.concatenate([a.links, b.links])
        rep, linked = rows["rep"].to_numpy(), np.flatnonzero(links)
        return pd.DataFrame({"rep": rep[linked], "links": links[linked], "parent": rep[join.parent[linked]]})

    return run


def _join_length(nodes: DataFrame, cosine: float, dtype: str, cells: int) -> DataFrame:
    """(rep, links, parent) of nodes (rep, n, vec) whose vectors have the same length."""
    sample = nodes.orderBy(F.xxhash64("rep"), "rep").limit(BASIS_ROWS).select("vec").collect()
    basis = Basis(unit(np.frombuffer(b"".join(r.vec for r in sample), dtype=dtype).reshape(len(sample), -1)), cosine)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                head = basis.head(unit(np.frombuffer(b"".join(rows["vec"]), dtype=dtype).reshape(len(rows), -1)))
                yield rows.assign(cells=basis.cells(head), head=list(head))

    coded = nodes.mapInPandas(code, "rep long, n long, vec binary, cells long, head array<double>")
    # equal cells are told apart by a hash, so that no crowd of vectors shares a key
    coded = shared_table(coded.withColumn("key", F.shiftleft("cells", 20).bitwiseOR(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)))).drop("cells"))
    total = coded.count()
    interval = max(LEAF, cells // max(1, len(sample[0].vec) // np.dtype(dtype).itemsize))  # a task's memory, whatever the dimension
    n = max(-(-total // interval), min(8, -(-total // 256)))
    if n > 1:
        cuts = coded.agg(F.percentile_approx("key", [k / n for k in range(1, n)], max(10_000, 10 * n)).alias("c")).first().c
    else:
        cuts = []

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(piece=np.searchsorted(np.array(cuts, dtype=np.int64), rows["key"], side="right").astype(np.int32))

    dealt = shared_table(coded.mapInPandas(deal, "rep long, n long, vec binary, head array<double>, key long, piece int"))
    dims = min(BOX_DIMS, len(sample[0].vec) // np.dtype(dtype).itemsize)
    ends = [f(F.col("head")[k]) for f in (F.min, F.max) for k in range(dims)]
    # a box of every interval; their number is that of the vectors over `interval`
    boxes = sorted((tuple(r) for r in dealt.groupBy("piece").agg(*ends).collect()), key=lambda r: r[0])
    ids = np.array([r[0] for r in boxes], dtype=np.int32)
    low, high = (np.array([r[1 + s * dims : 1 + (s + 1) * dims] for r in boxes]) for s in (0, 1))
    reach = (basis.epsilon + SLACK) ** 2

    def partners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for k in np.searchsorted(ids, rows["piece"].to_numpy()):
                near = ids[box_gap(low[k], high[k], low, high) <= reach]
                yield pd.DataFrame({"piece": ids[k], "i": np.minimum(ids[k], near), "j": np.maximum(ids[k], near)})

    pairs = dealt.select("piece").distinct().mapInPandas(partners, "piece int, i int, j int")
    rows = dealt.select("rep", "n", "vec", "key", "piece").join(pairs, "piece")
    return rows.groupBy("i", "j").applyInPandas(_join_intervals(basis, cosine, dtype), "rep long, links long, parent long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, cells: int = INTERVAL_CELLS) -> DataFrame:
    """Link vectors with a cosine of at least `cosine`, in double precision, and group what links reach.

    Returns (id_col, n_links, component_id, kept), one row per input row: the number of other vectors
    linked directly, the smallest id reachable, and whether that is the row's own. A vector that is null,
    empty or zero, or holds a null or a component that is not finite, links with nothing, and so does a
    vector of another length. Rows that repeat an id are vectors of their own. A row with a null id links
    with nothing and is kept. An empty table gives an empty result. Only the two columns are read. Ids are
    integers; ids of another type raise a TypeError.

    Equal vectors are one node with a weight. Nodes are sorted by the grid cells of their leading principal
    dimensions and cut into intervals of about `cells` numbers each. Intervals whose bounding boxes come
    within the radius meet in a task, which recurses into halves; it returns the number of links of each
    node and a spanning forest, never the pairs.
    """
    if not isinstance(vectors.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} is {vectors.schema[id_col].dataType.simpleString()}; ids must be integers")
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    base = vectors.select(F.col(id_col).cast("long").alias("__id"), F.col(vec_col).alias("__vec"))
    base = base.withColumn("__ok", usable(F.col("__vec")) & F.col("__id").isNotNull())
    base = base.select("__id", "__ok", "__vec", F.xxhash64("__vec").alias("__h1"), F.xxhash64(F.lit(7), "__vec").alias("__h2"))
    groups = base.where("__ok").groupBy("__h1", "__h2")
    nodes = groups.agg(F.min("__id").alias("rep"), F.count("*").alias("n"), F.first("__vec").alias("vec"))
    dtype = "<f4" if kind == "float" else "<f8"

    def as_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(vec=[np.asarray(v, dtype=dtype).tobytes() for v in rows["vec"]])

    nodes = shared_table(nodes.mapInPandas(as_bytes, "__h1 long, __h2 long, rep long, n long, vec binary"))
    lengths = [r[0] for r in nodes.select(F.length("vec")).distinct().collect()]
    parts = [_join_length(nodes.where(F.length("vec") == n).select("rep", "n", "vec"), cosine, dtype, cells) for n in sorted(lengths)]
    empty = base.sparkSession.createDataFrame([], "rep long, links long, parent long")
    found = empty
    for part in parts:
        found = found.unionByName(part)
    found = shared_table(found)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    group = components(found, "rep", "parent").select(F.col("id").alias("rep"), "component")
    nodes = nodes.select("__h1", "__h2", "rep", "n").join(links, "rep", "left").join(group, "rep", "left")
    nodes = nodes.select("__h1", "__h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    out = join_back(base.drop("__vec"), nodes, ["__h1", "__h2"])
    component = F.when(F.col("__ok"), F.col("c")).otherwise(F.col("__id"))
    return out.select(
        F.col("__id").alias(id_col),
        F.when(F.col("__ok"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("__id")).alias("kept"),
    )
