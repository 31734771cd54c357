"""Repeated passages: every string of a given length that starts more than once, found by hash-compared suffix sorts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import join_back, salt, salts, shared_table, text_or_empty, with_salts
from civicspark.llm.suffix_sort import BASE, LETTER, Contexts, powers, repeats

#: Bytes of an anchor; every string of the given length contains one.
ANCHOR = 64
#: Contexts that a sorting task gets in the mean, and that one bucket may bring to it before it is split.
GROUP, CROWD = 2_500, 8_192
#: Bytes of a text that are searched for anchors at a time, with an overlap that loses no string.
CHUNK = 1 << 18

_POWER = powers(CHUNK)
_INVERSE = powers(CHUNK, np.uint64(pow(int(BASE), -1, 1 << 64)))
_PLACE = np.uint64((1 << 21) - 1)


#: Rows that a Python task holds unpacked at a time.
ROWS = 200


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ROWS rows at most, whatever comes."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)


def _slide_min(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours: the end of one block and the beginning of the next."""
    n = len(key)
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[:n] = key
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(text: bytes, length: int, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the k bytes with the least hash in every string of `length` bytes, the leftmost of equals.

    Which place that is depends on the string alone, so equal strings have their anchors at the same place.
    """
    w = length - k + 1
    places, hashes = [], []
    with np.errstate(over="ignore"):
        for lo in range(0, max(1, len(text) - length + 1), CHUNK - length):
            part = np.frombuffer(text[lo : lo + CHUNK], dtype=np.uint8)
            n = len(part)
            if n < length:
                break
            prefix = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(LETTER[part] * _POWER[:n], out=prefix[1:])
            h = (prefix[k:] - prefix[:-k]) * _INVERSE[: n - k + 1]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(32)
            key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
            least = _slide_min(key, w)
            at = (least[np.flatnonzero(np.r_[True, least[1:] != least[:-1]])] & _PLACE).astype(np.int64)
            places.append(at + lo)
            hashes.append(h[at])
    if not places:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at, one = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[one]


def _digest(context: bytes, left: int) -> bytes:
    """16 bytes that two strings with as much before their anchors share only if they are equal: a cryptographic hash."""
    return hashlib.blake2b(context, digest_size=16, salt=left.to_bytes(4, "little")).digest()


def _find_anchors(length: int):
    reach = length - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cols = [], []
            for r, text in enumerate(batch.column(2).to_pylist()):
                at, h = anchors(text, length)
                if not len(at):
                    continue
                left, right = np.minimum(at, reach), np.minimum(len(text) - at, length)
                same = b"".join([_digest(text[p - a : p + b], a) for p, a, b in zip(at.tolist(), left.tolist(), right.tolist())])
                d = np.frombuffer(same, dtype=np.int64).reshape(-1, 2)
                row.append(np.full(len(at), r))
                cols.append(np.column_stack([h.view(np.int64), d, at, left, right]))
            if row:
                which, c = pa.array(np.concatenate(row)), np.concatenate(cols)
                ids = [batch.column(k).take(which) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*ids, *[pa.array(c[:, k]) for k in range(4)], *[pa.array(c[:, k].astype(np.int32)) for k in (4, 5)]],
                    names=["id", "th", "anchor", "d1", "d2", "at", "left", "right"],
                )

    return run


def _cut_contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in _small(batches):
            row, out, strings = [], [], []
            for r, (z, places) in enumerate(zip(batch.column("z").to_pylist(), batch.column("places").to_pylist())):
                text = unzip(z)
                for p in places:
                    row.append(r)
                    out.append((p["anchor"], p["at"], p["left"]))
                    strings.append(text[p["at"] - p["left"] : p["at"] + p["right"]])
            c = np.array(out, dtype=np.int64).reshape(-1, 3)
            which = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(which), batch.column("th").take(which), *[pa.array(c[:, k]) for k in range(3)], pa.array(strings, pa.binary())],
                names=["id", "th", "anchor", "at", "left", "context"],
            )

    return run


def _sort_group(length: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at = length - ANCHOR
        rows = rows.reset_index(drop=True)
        c = Contexts(rows["context"].tolist(), rows["left"].to_numpy(), rows["anchor"].to_numpy(), at, at + length)
        low, high = repeats(c, length)
        rows = rows.assign(start=rows["at"] - high, end=rows["at"] - low + length)[low >= 0]
        return rows[["id", "th", "start", "end"]]

    return run


def _halve(length: int):
    """Contexts of crowded buckets, cut for either half of the strings that a bucket compares.

    A bucket compares the strings that begin s bytes before the anchor, s from least to most. Those of one
    half share `core`, more bytes around the anchor than the anchor, whose hash is the key of a smaller bucket;
    a context is cut to what the strings of that half can hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            row, out, digests, strings = [], [], [], []
            given = (batch.column(c).to_pylist() for c in ("left", "context", "least", "most"))
            for r, (left, text, least, most) in enumerate(zip(*given)):
                right, middle = len(text) - left, (least + most) // 2
                for lo, hi in ((least, middle), (middle + 1, most)):
                    if max(lo, length - right) > min(hi, left):
                        continue  # no string of this half
                    core = _digest(text[left - lo : left + length - hi], lo)
                    a, b = min(left, hi), min(right, length - lo)
                    cut = text[left - a : left + b]
                    row.append(r)
                    out.append((lo, hi, a))
                    digests.append(core[:8] + _digest(cut, a))
                    strings.append(cut)
            c, d = np.array(out, dtype=np.int64).reshape(-1, 3), np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 3)
            which = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(which) for k in ("id", "th", "at")], *[pa.array(x[:, k]) for x in (d, c) for k in range(3)], pa.array(strings, pa.binary())],
                names=["id", "th", "at", "anchor", "d1", "d2", "least", "most", "left", "context"],
            )

    return run


def _split_crowds(contexts: DataFrame, length: int, crowd: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(parts of contexts whose buckets have at most `crowd` of them, spans found on the way).

    contexts: (id, th, anchor, at, left, context), distinct within a bucket. Crowded buckets are halved by
    where the compared strings begin; contexts that become equal cover each other and one of them goes on.
    A half of one string has nothing left to tell contexts apart, so this ends after log2(length) steps.
    """
    kind = contexts.schema["id"].dataType.simpleString()
    columns = ["id", "th", "anchor", "at", "least", "most", "left", "context"]
    contexts = contexts.withColumns({"least": F.lit(0).cast("long"), "most": F.lit(length - ANCHOR).cast("long")}).select(columns)
    parts, spans = [], []
    while True:
        contexts = contexts.withColumn("salt", salt("id", "th", "at"))
        sizes = shared_table(contexts.groupBy("anchor").agg(F.count("*").alias("n"), salts("salt").alias("salts")).where("n > 1"))
        small, crowded = (with_salts(sizes.where(c).select("anchor", "salts")) for c in (F.col("n") <= crowd, F.col("n") > crowd))
        parts.append(contexts.join(small, ["anchor", "salt"], "left_semi").select("id", "th", "anchor", "at", "left", "context"))
        if crowded.isEmpty():
            return parts, spans
        large = contexts.join(crowded, ["anchor", "salt"], "left_semi").drop("salt")
        made = f"id {kind}, th long, at long, anchor long, d1 long, d2 long, least long, most long, left long, context binary"
        halves = shared_table(large.mapInArrow(_halve(length), made)).withColumn("salt", salt("id", "th", "at"))
        key = ["anchor", "d1", "d2"]
        chosen = F.min_by(F.struct("id", "th", "at", "least", "most", "left", "context"), F.struct("id", "th", "at")).alias("c")
        classes = shared_table(halves.groupBy(*key).agg(chosen, F.count("*").alias("n"), salts("salt").alias("salts")))
        equal = halves.join(with_salts(classes.where("n > 1").select(*key, "salts")), [*key, "salt"])
        begin = F.col("at") - F.col("left")
        spans.append(equal.select("id", "th", begin.alias("start"), (begin + F.octet_length("context")).alias("end")))
        contexts = classes.select("c.*", "anchor").select(columns)


def repeated_spans(texts: DataFrame, length: int = 400, crowd: int = CROWD) -> DataFrame:
    """(id, th, start, end): byte spans whose union is what strings of `length` bytes that start anywhere else cover.

    texts: (id, th, z), z the text's bytes under zstandard; th tells rows of one id apart.

    Equal strings share an anchor, so strings are compared within buckets of equal anchors only. An
    occurrence's context is all that strings through its anchor can hold. Contexts equal to another (by a
    128-bit cryptographic digest) are covered whole and one of them goes on; the distinct ones of a bucket meet
    in a suffix sort. A bucket with more than `crowd` distinct contexts is first split into smaller ones by
    the bytes around its anchor, as often as needed; all buckets end in the sort.
    """
    kind = texts.schema["id"].dataType.simpleString()
    unzip = lambda f: lambda batches: f(_unzipped(batches))
    names = f"id {kind}, th long, anchor long, d1 long, d2 long, at long, left int, right int"
    found = shared_table(texts.mapInArrow(unzip(_find_anchors(length)), names)).withColumn("salt", salt("id", "th", "at"))
    firsts = [F.first(c).alias(c) for c in ("id", "th", "at", "left", "right")]
    classes = shared_table(found.groupBy("anchor", "d1", "d2").agg(F.count("*").alias("n"), salts("salt").alias("salts"), *firsts))
    classes = classes.withColumn("salt", salt("d1", "d2"))
    several = classes.groupBy("anchor").agg(F.count("*").alias("contexts"), salts("salt").alias("parts")).where("contexts > 1")
    meet = classes.join(with_salts(several.select("anchor", "parts"), "parts"), ["anchor", "salt"], "left_semi")
    place = F.struct("anchor", "at", "left", "right")
    places = meet.groupBy("id", "th").agg(F.collect_list(place).alias("places"))
    cut = join_back(texts, places, ["id", "th"], "inner").select("id", "th", "z", "places")
    contexts = shared_table(cut.mapInArrow(_cut_contexts(length), f"id {kind}, th long, anchor long, at long, left long, context binary"))
    parts, more = _split_crowds(contexts, length, crowd)
    groups = max(1, -(-contexts.count() // GROUP))
    spans = None
    for part in parts:
        dealt = part.withColumn("g", F.pmod(F.xxhash64("anchor"), F.lit(groups)))
        sorted_ = dealt.groupBy("g").applyInPandas(_sort_group(length), f"id {kind}, th long, start long, end long")
        spans = sorted_ if spans is None else spans.unionByName(sorted_)
    for part in more:
        spans = spans.unionByName(part)
    copies = with_salts(classes.where("n > 1").select("anchor", "d1", "d2", "salts"))
    whole = found.join(copies, ["anchor", "d1", "d2", "salt"])
    whole = whole.select("id", "th", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("end"))
    return spans.unionByName(whole)


def _unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unzip = zstandard.ZstdDecompressor().decompress
    for batch in _small(batches):
        text = pa.array([unzip(z) for z in batch.column("z").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), text], names=["id", "th", "text"])


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Union of spans, as maximal runs in order."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zip_ = zstandard.ZstdCompressor(level=1).compress
    for batch in _small(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([zip_(t) for t in batch.column(2).to_pylist()], pa.binary())], names=["id", "th", "z"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, crowd: int = CROWD) -> DataFrame:
    """Remove every byte that a string of `length` bytes covers which also starts anywhere else.

    Returns (id_col, n_bytes, spans, kept, kept_sha256), one row per input row: spans are the maximal
    removed runs (start, end) in bytes of the UTF-8 text, kept the other bytes. Overlaps count, strings are
    judged on the input, and matches do not cross rows. Null and empty texts have no bytes. Null ids are
    ids; rows that repeat an id are texts of their own, so equal rows lose all that is longer than `length`.
    An empty table gives an empty result. Only the two named columns are read.
    """
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    raw = base.select("id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    texts = raw.mapInArrow(_zipped, f"id {kind}, th long, z binary")
    spans = repeated_spans(texts, length, crowd).groupBy("id", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    whole = join_back(texts, spans, ["id", "th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in _small(batches):
            n, runs, rest, sha = [], [], [], []
            for z, found in zip(batch.column("z").to_pylist(), batch.column("spans").to_pylist()):
                text, gone = unzip(z), merged(found)
                edges = [0, *[x for s in gone for x in s], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                n.append(len(text))
                runs.append([{"start": a, "end": b} for a, b in gone])
                rest.append(kept)
                sha.append(hashlib.sha256(kept).hexdigest())
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(runs, span), pa.array(rest, pa.binary()), pa.array(sha, pa.string())],
                names=["id", "n_bytes", "spans", "kept", "kept_sha256"],
            )

    out = whole.select("id", "th", "z", "spans").mapInArrow(run, f"id {kind}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
