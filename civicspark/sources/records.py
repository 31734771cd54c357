"""Records of JSON collections of any layout, split over tasks however large a file is.

Spark's text source cuts files at every closing bracket and deals their byte ranges to tasks, so no layout of
lines is needed and any file system will do. A bracket may stand in a string, and a range may begin anywhere: a
first pass notes for each range what it does to the state of a reader (inside a string or not, and how deep), for
either state it may begin in. Prefix sums over a file's ranges then tell each range its true beginning,
and a second pass cuts the records out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicspark.storage import shared_table

_OPEN, _CLOSE = (ord("{"), ord("[")), (ord("}"), ord("]"))
#: What a cut piece of a file is: a whole record, the begin, middle or end of one that lies in several ranges, or the last key of a range.
WHOLE, BEGIN, MIDDLE, END, KEY = range(5)


def _outside(b: np.ndarray, in_string: int) -> tuple[np.ndarray, int]:
    """Which bytes are outside of strings (of a quote: what follows it), and whether the end is in one."""
    quotes = np.flatnonzero(b == ord('"'))
    after_slash = quotes[(quotes > 0) & (b[quotes - 1] == ord("\\"))]
    if len(after_slash):  # escaped if an odd run of backslashes stands before
        last_other = np.maximum.accumulate(np.where(b != ord("\\"), np.arange(len(b)), -1))
        odd = (after_slash - 1 - last_other[after_slash - 1]) % 2 == 1
        quotes = np.setdiff1d(quotes, after_slash[odd], assume_unique=True)
    toggles = np.zeros(len(b), dtype=np.int64)
    toggles[quotes] = 1
    state = (np.cumsum(toggles) + in_string) & 1
    return state == 0, int(state[-1]) if len(b) else in_string


def _steps(b: np.ndarray) -> np.ndarray:
    """1 at opening brackets, -1 at closing ones."""
    return np.isin(b, _OPEN).astype(np.int64) - np.isin(b, _CLOSE)


def _chunks(batches: Iterator[pa.RecordBatch], sep: bytes) -> Iterator[tuple[tuple, bytes, tuple]]:
    """((file, range), bytes, further columns) of consecutive rows of one range; every row ended in sep."""
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        rows = zip(*columns)
        for key, some in groupby(rows, key=lambda r: (r[0], r[1])):
            some = list(some)
            yield key, b"".join(v for r in some for v in (r[2], sep)), some[0][3:]


def _summaries(sep: bytes):
    """For each range: its bytes, the parity of its quotes, and its change of depth if it begins outside or inside of a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple, list[int]] = {}
        for key, chunk, _ in _chunks(batches, sep):
            row = rows.setdefault(key, [0, 0, 0, 0])
            b = np.frombuffer(chunk, dtype=np.uint8)
            outside, parity = _outside(b, 0)
            steps = _steps(b)
            change = (int(steps[outside].sum()), int(steps[~outside].sum()))
            for start in (0, 1):
                row[2 + start] += change[start ^ row[1]]
            row[0] += len(chunk)
            row[1] ^= parity
        if rows:
            names = ["file", "block", "n_bytes", "parity", "depth_outside", "depth_inside"]
            columns = [list(c) for c in zip(*[(*key, *row) for key, row in rows.items()])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "file" else pa.int64()) for n, c in zip(names, columns)], names=names)

    return run


class _Cutter:
    """Cuts the records out of one range: the elements of arrays at a depth, in a record or not at the beginning."""

    def __init__(self, key: tuple, depth: int, in_string: int, offset: int, level: int):
        self.key, self.depth, self.in_string, self.offset, self.level = key, depth, in_string, offset, level
        self.name, self.start, self.held, self.inside = None, None, [], depth >= level

    def _piece(self, kind: int, whole: bytes) -> tuple:
        return (*self.key, kind, self.start, self.name, whole)

    def cut(self, chunk: bytes) -> Iterator[tuple]:
        b = np.frombuffer(chunk, dtype=np.uint8)
        outside, self.in_string = _outside(b, self.in_string)
        steps = np.where(outside, _steps(b), 0)
        depth = self.depth + np.cumsum(steps)
        marks = outside & (((b == ord(",")) & (depth == self.level)) | ((steps > 0) & (depth == self.level)) | ((steps < 0) & (depth == self.level - 1)))
        if self.level == 2:
            marks |= outside & (b == ord(":")) & (depth == 1)
        begun = 0
        for at in np.flatnonzero(marks).tolist():
            c = chunk[at : at + 1]
            if c == b":":
                end = chunk.rfind(b'"', 0, at)
                start = chunk.rfind(b'"', 0, max(end, 0))
                self.name = json.loads(chunk[start : end + 1]) if start >= 0 else ""
                continue
            if c == b"{":  # an object: its members are no records, in the ranges that follow neither
                self.name, self.inside = "", False
                continue
            if c != b"[" and self.inside:
                whole = b"".join(self.held) + chunk[begun:at]
                yield self._piece(END if self.start is None else WHOLE, whole)
            self.inside = c == b"[" or c == b"," and self.inside
            self.held, begun, self.start = [], at + 1, self.offset + at + 1
        if self.inside:
            self.held.append(chunk[begun:])
        self.depth = int(depth[-1]) if len(b) else self.depth
        self.offset += len(chunk)

    def rest(self) -> Iterator[tuple]:
        if self.inside:
            yield self._piece(MIDDLE if self.start is None else BEGIN, b"".join(self.held))
        yield (*self.key, KEY, None, self.name, b"")


def _cutting(sep: bytes, level: int):
    names = ["file", "block", "kind", "pos", "key", "value"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        rows = [(*r[:5], r[5].decode("utf-8", "replace")) for r in rows]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, rows, held = None, [], 0
        for key, chunk, (depth, in_string, offset) in _chunks(batches, sep):
            if cutter is None or cutter.key != key:
                rows += cutter.rest() if cutter else ()
                cutter = _Cutter(key, depth, in_string, offset, level)
            rows += cutter.cut(chunk)
            held += len(chunk)
            if held > 1 << 22:
                if rows:
                    yield batch_of(rows)
                rows, held = [], 0
        rows += cutter.rest() if cutter else ()
        if rows:
            yield batch_of(rows)

    return run


def records(spark: SparkSession, path: str, collection: str | None = None, sep: str = "}") -> DataFrame:
    """(file, pos, value): the JSON texts of the elements of an array in each file.

    With collection, the array is that member of the file's object; without, the file's outermost array, and
    what stands around it, as of a script, is left. pos is the byte at which a record begins. sep is a
    closing bracket that every record holds: files are split at it. Records, files and folders may have
    any layout and size and may differ in it. An empty array gives no rows. A file that ends inside a record or a
    string is an error that names it; a null byte of the encoding is replaced.
    """
    if collection and sep in collection:
        raise ValueError("the collection's name holds the separator")
    raw = spark.read.text(path, lineSep=sep)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"), F.col("_metadata.file_size").alias("size"))
    mark, level = sep.encode(), 2 if collection else 1
    kinds = "file string, block long, n_bytes long, parity long, depth_outside long, depth_inside long"
    ranges = shared_table(raw.select("file", "block", "value").mapInArrow(_summaries(mark), kinds))

    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    starts = ranges.withColumn("in_string", F.pmod(total("parity"), F.lit(2))).withColumn("offset", total("n_bytes"))
    starts = starts.withColumn("change", F.when(F.col("in_string") == 0, F.col("depth_outside")).otherwise(F.col("depth_inside")))
    starts = starts.withColumn("depth", total("change"))
    # the text source does not tell whether a file's last row ended in the separator; its size does
    ended = starts.select("file", F.sum("n_bytes").over(whole).alias("seen"), F.sum("change").over(whole).alias("left"), F.pmod(F.sum("parity").over(whole), F.lit(2)).alias("open")).distinct()
    sizes = raw.select("file", "size").groupBy("file").agg(F.first("size").alias("size"))
    cut_off = ended.join(sizes, "file").where((F.col("open") == 1) | (F.col("left") + F.when(F.col("seen") > F.col("size"), 1).otherwise(0) > 0))
    bad = cut_off.where(~F.col("file").rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate)$")).select("file").orderBy("file").first()
    if bad:
        raise ValueError(f"{bad.file} ends inside of a record")

    # a row for each byte range, which the driver plans one by one as well: of bounded size
    known = F.broadcast(starts.select("file", "block", "depth", "in_string", "offset"))
    placed = raw.select("file", "block", "value").join(known, ["file", "block"])
    pieces = shared_table(placed.mapInArrow(_cutting(mark, level), "file string, block long, kind int, pos long, key string, value string"))

    if collection:  # ranges in which no key has been seen yet have the last one before
        keys = pieces.where(F.col("kind") == KEY).select("file", "block", F.last("key", ignorenulls=True).over(before).alias("inherited"))
        pieces = pieces.join(F.broadcast(keys), ["file", "block"]).withColumn("key", F.coalesce("key", "inherited"))
    pieces = pieces.where(F.col("kind") != KEY)
    parts = pieces.where(F.col("kind") != WHOLE)
    number = F.count_if(F.col("kind") == BEGIN).over(Window.partitionBy("file").orderBy("block", F.col("kind") == BEGIN))
    joined = parts.withColumn("number", number).groupBy("file", "number").agg(
        F.min("pos").alias("pos"),
        F.max(F.when(F.col("kind") == BEGIN, F.col("key"))).alias("key"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", "value"))), lambda p: p.value), "").alias("value"),
    )
    out = pieces.where(F.col("kind") == WHOLE).select("file", "pos", "key", "value").unionByName(joined.select("file", "pos", "key", "value"))
    if collection:
        out = out.where(F.col("key") == collection)
    value = F.regexp_replace(F.regexp_replace("value", r"^[\s]+", ""), r"[\s]+$", "")
    return out.select("file", "pos", value.alias("value")).where("value <> '' and pos is not null")
