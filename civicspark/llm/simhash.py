"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared bit-sliced within blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.bitsliced import link_buckets
from civicspark.llm.common import join_back, shared_table, text_or_empty
from civicspark.llm.components import components

#: Rows of one bucket that are compared in one task; larger buckets are compared piece by piece.
PIECE = 4096
#: Rows that a group of buckets has in the mean.
GROUP = 20_000


def simhash(h: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes."""
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, n: int = 3, seed: int = 42) -> int:
    """SimHash of a text: a bit is set if it is set in over half of the XXH64 of its n-word shingles."""
    found = text.encode("utf-8", "replace").lower().split()  # of bytes: A-Z, and ASCII white space
    if not found:
        return 0
    whole = b" ".join(found)
    if len(found) < n:
        hashes = [xxhash.xxh64_intdigest(whole, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a:b], seed) for a, b in zip(starts[: len(found) - n + 1].tolist(), ends[n - 1 :].tolist())]
    return simhash(np.array(hashes, dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, n: int = 3, seed: int = 42) -> DataFrame:
    """(__id, __th, __fp long): one row per input row, __th the hash of its text; a null text is empty."""
    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__th"), text.alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x, n, seed) for x in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["__id", "__th", "__fp"])

    kind = base.schema["__id"].dataType.simpleString()
    return base.mapInArrow(run, f"__id {kind}, __th long, __fp long")


def _bucket_links(radius: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bucket", "fp"], kind="stable")
        fps = rows["fp"].to_numpy()
        parent = link_buckets(rows["bucket"].to_numpy(), fps.view(np.uint64), radius)
        child = np.flatnonzero(parent != np.arange(len(parent)))
        return pd.DataFrame({"a": fps[child], "b": fps[parent[child]]}).drop_duplicates()

    return run


def fingerprint_links(fps: DataFrame, radius: int = 2, piece: int = PIECE) -> DataFrame:
    """(a, b): links that connect all pairs of distinct fingerprints (column __fp) at radius bits or fewer.

    Cut in radius + 2 blocks, two such fingerprints agree in two blocks at least, so each pair of blocks
    is a table whose equal keys make a bucket; that loses no pair. Buckets of more than piece rows are
    dealt into pieces by hash and every two pieces meet in a task of their own. A task returns a spanning
    forest of its links, not its pairs.
    """
    edges = np.linspace(0, 64, radius + 3).astype(int)
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(radius + 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = [
        F.struct(F.lit(k).alias("t"), F.col("__fp").bitwiseAND(F.lit(signed[i] | signed[j]).cast("long")).alias("k"))
        for k, (i, j) in enumerate(combinations(range(radius + 2), 2))
    ]
    keyed = fps.select("__fp", F.explode(F.array(*keys)).alias("key")).select("__fp", "key.t", "key.k")
    crowded = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    rows = keyed.join(crowded, ["t", "k"]).withColumn("pieces", F.ceil(F.col("n") / piece).cast("int"))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("__fp"), F.col("pieces")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    rows = shared_table(rows.select(F.xxhash64("t", "k", F.least("i", "j"), F.greatest("i", "j")).alias("bucket"), F.col("__fp").alias("fp")))
    groups = max(8, -(-rows.count() // GROUP))
    rows = rows.withColumn("g", F.pmod(F.xxhash64("bucket"), F.lit(groups)))
    return rows.groupBy("g").applyInPandas(_bucket_links(radius), "a long, b long")


def _grouped(fps: DataFrame, radius: int) -> DataFrame:
    """(__fp, __group, __low) of the distinct fingerprints of fps (__id, __fp): the group, and the fingerprint's smallest id."""
    nodes = shared_table(fps.groupBy("__fp").agg(F.min("__id").alias("__low")))
    group = components(fingerprint_links(nodes.select("__fp"), radius), "a", "b").select(F.col("id").alias("__fp"), "component")
    return nodes.join(group, "__fp", "left").select("__fp", F.coalesce("component", "__fp").alias("__group"), "__low")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """Group documents whose fingerprints differ in radius bits or fewer, directly or through others.

    Returns (id_col, fingerprint long, component_id), one row per input row; component_id is the smallest
    id of the group. Null and empty texts have fingerprint zero and link like any other; a text of fewer
    than n words is one shingle. Rows with a null id take the group's smallest id that is not null, and
    null if it has none. Rows that repeat an id stay as they are. An empty table gives an empty result.
    Only the two named columns are read, so names of others cannot clash.

    Equal fingerprints are one node with its smallest id, so copies never meet each other in a task.
    """
    fps = shared_table(fingerprints(docs, id_col, text_col, n, seed))
    nodes = _grouped(fps, radius)
    lowest = nodes.groupBy("__group").agg(F.min("__low").alias("component_id"))
    nodes = nodes.join(lowest, "__group").select("__fp", "component_id")
    return join_back(fps, nodes, ["__fp"]).select(F.col("__id").alias(id_col), F.col("__fp").alias("fingerprint"), "component_id")
