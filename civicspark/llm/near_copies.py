"""Near copies by Jaccard similarity of word shingles: SimHash candidates of a wide radius, checked on the shingles."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.bitsliced import link_buckets, merge
from civicspark.llm.common import join_back, numbered, salt, salts, shared_table, text_or_empty, with_salts
from civicspark.llm.components import components
from civicspark.llm.simhash import simhash

#: Fingerprints that are compared in one task; larger buckets are compared piece by piece.
PIECE = 65_536
#: Texts of one candidate group that are compared in one task, and texts that a task has in the mean.
TEXTS, GROUP = 2048, 4096
#: Shingles of the texts of one bucket, and of a task in the mean; a text with more counts as this many, as it cannot be dealt.
SHINGLES = 1 << 22


def _mixed(h: np.ndarray) -> np.ndarray:
    """SplitMix64's last steps: every bit of h counts for every bit of the result."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str, seed: int) -> np.ndarray:
    found = text.encode("utf-8", "replace").lower().split()  # of bytes: A-Z, and ASCII white space
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in found], dtype=np.uint64)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of n words; fewer words are one run, none have none."""
    n = min(n, len(words))
    if not n:
        return words
    h = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(h)])
    return np.unique(h)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, n: int, sketch_n: int, seed: int) -> DataFrame:
    """(__id, __th, __set, __fps array<long>, __size int): one row per input row.

    __th is the hash of its text, __set and __size are those of its set of n-word shingles, __fps two SimHashes of
    its set of sketch_n-word shingles, by hashes that are independent.
    """
    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__th"), text.alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(2).to_pylist():
                words = word_hashes(x, seed)
                own, sketch = shingles(words, n), shingles(words, sketch_n)
                out.append((xxhash.xxh64_intdigest(own.tobytes()), len(own), simhash(sketch), simhash(_mixed(sketch + np.uint64(1)))))
            of = np.array(out, dtype=np.uint64).reshape(-1, 4).view(np.int64)
            fps = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1, dtype=np.int32) * 2), pa.array(of[:, 2:].ravel()))
            cols = [pa.array(of[:, 0].copy()), fps, pa.array(of[:, 1].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["__id", "__th", "__set", "__fps", "__size"])

    kind = base.schema["__id"].dataType.simpleString()
    return base.mapInArrow(run, f"__id {kind}, __th long, __set long, __fps array<long>, __size int")


def _dealt(rows: DataFrame, keys: list[str], by: str, piece: int, shingles: int | None = None) -> DataFrame:
    """rows with a bucket: those of equal keys meet in one; more than piece, or of more shingles, are dealt into pieces, and every two pieces meet.

    The rows of a key that many share meet its size in parts.
    """
    pieces = F.ceil(F.count("*") / piece)
    if shingles:
        pieces = F.greatest(pieces, F.ceil(F.sum(F.least(F.col("__size").cast("long"), F.lit(shingles))) / shingles))
    rows = rows.withColumn("salt", salt(by))
    sizes = with_salts(rows.groupBy(*keys).agg(pieces.cast("int").alias("pieces"), salts("salt").alias("salts")))
    rows = rows.join(sizes, [*keys, "salt"]).drop("salt").withColumn("i", F.pmod(F.xxhash64(by), F.col("pieces")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return rows.withColumn("bucket", F.xxhash64(*keys, F.least("i", "j"), F.greatest("i", "j"))).drop("pieces", "i", "j")


def candidate_links(nodes: DataFrame, radius: int, similarity: float, piece: int = PIECE) -> DataFrame:
    """(a, b): links that connect all pairs of nodes (__set, __fps, __size) with a fingerprint at radius bits or fewer
    and with sizes that the similarity allows.

    Of radius + 2 blocks of the fingerprint, such a pair agrees in two at least. Rows of one value of the first of
    them meet in a task, which makes buckets of the second; that loses no pair.
    """
    edges = np.linspace(0, 64, radius + 3).astype(int).tolist()
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = [F.struct(F.lit(t).alias("t"), F.col("__fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for t, m in enumerate(signed[:-1])]
    rows = nodes.select("__set", "__size", F.posexplode("__fps").alias("f", "__fp"))
    rows = rows.select("__set", "__size", "f", "__fp", F.explode(F.array(*keys)).alias("key")).select("__set", "__size", "f", "__fp", "key.t", "key.k")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__size", "__set"], kind="stable")
        fps, sizes, names = rows["__fp"].to_numpy().view(np.uint64), rows["__size"].to_numpy().astype(np.int64), rows["__set"].to_numpy()
        parent = np.arange(len(rows))
        for t in range(int(rows["t"].iloc[0]) + 1, len(masks)):
            value = ((fps & np.uint64(masks[t])) >> np.uint64(edges[t])).astype(np.int64)
            order = np.argsort(value, kind="stable")
            key = (value << 40) + sizes
            last = np.searchsorted(key[order], ((value << 40) + np.floor(sizes / similarity + 1e-9).astype(np.int64))[order], side="right")
            up = link_buckets(value[order], fps[order], radius, last)
            child = np.flatnonzero(up != np.arange(len(up)))
            merge(parent, order[child], order[up[child]])
        child = np.flatnonzero(parent != np.arange(len(parent)))
        return pd.DataFrame({"a": names[child], "b": names[parent[child]]})

    return _dealt(rows, ["f", "t", "k"], "__set", piece).groupBy("bucket").applyInPandas(run, "a long, b long")


def similar_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Parent of each set: those linked by pairs of the similarity or more share a tree. No set repeats a value.

    With values in one order, the rare ones first, two such sets share one of their first values; pairs that do
    are counted, unless their trees have met.
    """
    parent = np.arange(len(sets))
    _, rank, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(count), dtype=np.int64)
    place[np.lexsort((np.arange(len(count)), count))] = np.arange(len(count))
    ends = np.cumsum([len(s) for s in sets])
    ranked = [np.sort(place[rank[b - len(s) : b]]) for s, b in zip(sets, ends.tolist())]
    single = int((count == 1).sum())  # these come first and no other set has them
    index = defaultdict(list)
    for x in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        own = ranked[x]
        first = own[: len(own) - ceil(similarity * len(own) - 1e-9) + 1]
        first = first[first >= single].tolist()
        met = np.unique(np.fromiter((y for v in first for y in index[v]), dtype=np.int64))
        for y in met.tolist():
            if parent[x] == parent[y] or len(ranked[y]) < similarity * len(own) - 1e-9:
                continue
            both = len(np.intersect1d(own, ranked[y], assume_unique=True))
            if both >= similarity * (len(own) + len(ranked[y]) - both) - 1e-9:
                merge(parent, np.array([x]), np.array([y]))
        for v in first:
            index[v].append(x)
    return parent


def similar_links(texts: DataFrame, n: int, seed: int, similarity: float) -> DataFrame:
    """(a, b): links that connect all pairs of texts (g, bucket, __set, __text) of a bucket with the similarity."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.groupby("bucket"):
            names = part["__set"].to_numpy()
            up = similar_sets([shingles(word_hashes(x, seed), n) for x in part["__text"]], similarity)
            child = np.flatnonzero(up != np.arange(len(up)))
            out.append(pd.DataFrame({"a": names[child], "b": names[up[child]]}))
        return pd.concat(out)

    return texts.groupBy("g").applyInPandas(run, "a long, b long")


def _groups(docs: DataFrame, sets: DataFrame, text_col: str, n: int, seed: int, radius: int, similarity: float, texts: int = TEXTS, most: int = SHINGLES) -> DataFrame:
    """(__set, __group) of the distinct sets that are similar to another.

    Texts of one candidate group meet in buckets of about 2 * texts texts and 2 * most shingles at most.
    """
    nodes = shared_table(sets.groupBy("__set").agg(F.min("__fps").alias("__fps"), F.min("__size").alias("__size"), F.min("__th").alias("__th")))
    near = components(candidate_links(nodes.where("__size > 0"), radius, similarity), "a", "b").withColumnRenamed("id", "__set")
    near = near.join(nodes.select("__set", "__th", "__size"), "__set")
    near = shared_table(_dealt(near, ["component"], "__set", texts, most).select("bucket", "__set", "__th", "__size"))
    count, size = near.agg(F.count("*"), F.coalesce(F.sum(F.least(F.col("__size").cast("long"), F.lit(most))), F.lit(0))).first()
    near = near.drop("__size").withColumn("g", F.pmod(F.xxhash64("bucket"), F.lit(max(8, -(-count // GROUP), -(-size // most)))))
    wanted = near.select(F.col("__th").alias("__want")).distinct()
    text = text_or_empty(text_col)
    whole = docs.select(F.xxhash64(text).alias("__th"), text.alias("__text")).join(wanted, F.col("__th") == F.col("__want"), "left_semi")
    whole = whole.dropDuplicates(["__th"]).join(near, "__th")
    links = similar_links(whole.select("g", "bucket", "__set", "__text"), n, seed, similarity)
    return components(links, "a", "b").select(F.col("id").alias("__set"), F.col("component").alias("__group"))


def one_of_each_group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, sketch_n: int = 3, radius: int = 12, similarity: float = 0.8, seed: int = 42,
    texts: int = TEXTS, most: int = SHINGLES,
) -> DataFrame:
    """docs without near copies: of each group the row with the smallest id stays.

    Two texts are near copies if the Jaccard similarity of their sets of n-word shingles (lower-cased A-Z) is the
    given one or more; a group is what such pairs connect. Candidates are texts with one of two SimHashes at radius
    bits or fewer, directly or through others; an exchanged word changes fewer of the sketch_n-word shingles that
    these are made of. The n-word shingles decide. A text of fewer than n words is one shingle, null
    and empty texts are alike. A null id sorts first. Of rows with equal id and text one stays, whichever it is.
    The columns of docs may have any names; an empty table stays empty.

    Equal sets are one node. Texts of candidates only are read again; those of one candidate group meet in
    buckets of a bounded number of texts and of shingles (texts, most), every two of its parts in one.
    """
    rows, (key, text) = numbered(docs, id_col, text_col)
    sets = shared_table(shingle_sets(rows, key, text, n, sketch_n, seed))
    placed = sets.join(_groups(rows, sets, text, n, seed, radius, similarity, texts, most), "__set", "left")
    placed = placed.select(F.coalesce("__group", "__set").alias("__group"), "__id", "__th")
    stays = placed.groupBy("__group").agg(F.min(F.struct("__id", "__th")).alias("s")).select("s.__id", "s.__th")
    keyed = rows.withColumns({"__id": F.col(key), "__th": F.xxhash64(text_or_empty(text))})
    kept = join_back(keyed, shared_table(stays), ["__id", "__th"], "left_semi").dropDuplicates(["__id", "__th"])
    return kept.select(rows.columns).toDF(*docs.columns)
