"""Ranked lexical search: K2-treaps over the term-document grid, items answered best first."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicspark.llm.common import shared_table, text_or_empty

#: Occurrences and documents of one segment of the index; a longer document is a segment of its own.
SEGMENT_TERMS, SEGMENT_DOCS = 3_000_000, 8192
#: Items, and characters of their texts, that are searched in one pass over the index.
BLOCK_ITEMS, BLOCK_CHARS = 2048, 1 << 22
#: Document ranges that are expanded at a time.
STEP = 64

#: A term in Java's regular expressions: no ASCII character but letters and digits.
TERM_RE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same on lower-cased UTF-8.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms(text: str) -> list[bytes]:
    """The terms of a text in order; lower() of bytes changes A-Z only."""
    return _TERM.findall(text.encode().lower())


class Numbers(dict):
    """Terms numbered as they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def term_weight(docs: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holders + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, occurrences: int) -> np.ndarray:
    """What a term that occurs tf times in a document of n terms adds to its score for each unit of weight."""
    damping = 10 + (90 * n * docs) // max(occurrences, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * damping)


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of x, up to 31 of them, at the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


#: Place of a child among the children there are, by mask of children and number of the child; -1: none.
_PLACE = np.array([[(mask & ((1 << c) - 1)).bit_count() if mask >> c & 1 else -1 for c in range(4)] for mask in range(16)], dtype=np.int64)
_COUNT = np.array([mask.bit_count() for mask in range(16)], dtype=np.int64)


class K2Treap:
    """A grid of points with values as a compressed quadtree whose cells hold the greatest value below them.

    masks[l] has four bits for each cell of level l, one for each quarter with points in it; maxima[l]
    the cells' greatest values. A row's cells are found by the bits of its number from the top.
    """

    def __init__(self, masks: list[np.ndarray], maxima: list[np.ndarray]):
        self.height = len(masks)
        # one empty cell at the end of each level stands for what is not there
        self.masks = [np.append(m, 0).astype(np.uint8) for m in masks]
        self.maxima = [np.append(m, 0).astype(np.int64) for m in maxima]
        self.firsts = [np.concatenate([[0], np.cumsum(_COUNT[m])[:-1]]) if len(m) else np.zeros(1, dtype=np.int64) for m in self.masks]

    @classmethod
    def of(cls, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, size: int) -> K2Treap:
        """Points (rows, cols), no two alike, of a grid of size x size."""
        height = max(1, int(size - 1).bit_length())
        codes = (_spread(rows) << np.uint64(1)) | _spread(cols)
        order = np.argsort(codes)
        codes, top = codes[order], values[order].astype(np.int64)
        masks, maxima = [], [top]
        for _ in range(height):
            parents = codes >> np.uint64(2)
            starts = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]])) if len(parents) else np.zeros(0, dtype=np.int64)
            bits = np.left_shift(np.uint8(1), (codes & np.uint64(3)).astype(np.uint8))
            masks.append(np.bitwise_or.reduceat(bits, starts) if len(starts) else bits)
            top = np.maximum.reduceat(top, starts) if len(starts) else top
            maxima.append(top)
            codes = parents[starts]
        return cls(masks[::-1], maxima[::-1])

    def dumps(self) -> bytes:
        """Masks two to a byte and, level by level, how far a cell's value is below its parent's, byte planes compressed."""
        codec, out = pa.Codec("zstd", compression_level=1), [self.height.to_bytes(4, "little")]

        def put(raw: bytes) -> None:
            packed = codec.compress(raw, asbytes=True)
            out.extend((len(raw).to_bytes(8, "little"), len(packed).to_bytes(8, "little"), packed))

        for m, firsts, below, own in zip(self.masks, self.firsts, self.maxima[1:], self.maxima):
            m = m[:-1]
            even = np.append(m, 0) if len(m) % 2 else m
            put((even[::2] | (even[1::2] << 4)).astype(np.uint8).tobytes())
            gap = (np.repeat(own[:-1], _COUNT[m]) - below[:-1]).astype("<u4")
            put(np.ascontiguousarray(gap.view(np.uint8).reshape(-1, 4).T).tobytes())
        put(self.maxima[0][:-1].astype("<u4").tobytes())
        return b"".join(out)

    @classmethod
    def loads(cls, raw: bytes) -> K2Treap:
        codec, at = pa.Codec("zstd"), 4

        def get() -> np.ndarray:
            nonlocal at
            size, packed = (int.from_bytes(raw[at + i : at + i + 8], "little") for i in (0, 8))
            at += 16 + packed
            return np.frombuffer(codec.decompress(raw[at - packed : at], decompressed_size=size, asbytes=True), dtype=np.uint8) if size else np.zeros(0, dtype=np.uint8)

        height = int.from_bytes(raw[:4], "little")
        packed, gaps = [], []
        for _ in range(height):
            two = get()
            packed.append(np.stack([two & 15, two >> 4], axis=1).reshape(-1))
            gaps.append(np.ascontiguousarray(get().reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64))
        maxima = [np.ascontiguousarray(get()).view("<u4").astype(np.int64)]
        masks = []
        for two, gap in zip(packed, gaps):
            m = two[: len(maxima[-1])]
            masks.append(m)
            maxima.append(np.repeat(maxima[-1], _COUNT[m]) - gap)
        return cls(masks, maxima)

    def best(self, rows: np.ndarray, weights: np.ndarray, ids: np.ndarray, top: Top) -> None:
        """Offer `top` the columns with the highest sums of weight times value over the rows.

        The rows' paths go down together, over one range of columns at a time: the range with the highest
        bound first, up to STEP ranges of one level at once. A range that cannot enter the top is left. ids, ascending,
        are the columns' ids.
        """
        root = np.zeros((1, len(rows)), dtype=np.int64)
        bound = int((self.maxima[0][root] @ weights)[0])
        heap, made = [(-bound, 0, 0, root, np.zeros(1, dtype=np.int64), np.array([bound]))], 1
        while heap and -heap[0][0] >= top.least:
            _, level, _, cells, cols, bounds = heapq.heappop(heap)
            level = -level
            keep = top.may_enter(bounds, ids[cols << (self.height - level)])
            if level == self.height:
                top.offer(bounds[keep], ids[cols[keep]])
                continue
            cells, cols = cells[keep], cols[keep]
            if not len(cols):
                continue
            row_bits = (rows >> (self.height - 1 - level)) & 1
            masks, firsts = self.masks[level][cells], self.firsts[level][cells]
            none, halves = len(self.maxima[level + 1]) - 1, []
            for side in (0, 1):
                place = _PLACE[masks, 2 * row_bits + side]
                halves.append(np.where(place < 0, none, firsts + place))
            cells, cols = np.concatenate(halves), np.concatenate([2 * cols, 2 * cols + 1])
            bounds = self.maxima[level + 1][cells] @ weights
            order = np.argsort(-bounds, kind="stable")
            order = order[: np.searchsorted(-bounds[order], 0)]  # without the ranges that hold none of the terms
            for i in range(0, len(order), STEP):
                part = order[i : i + STEP]
                if bounds[part[0]] < top.least:
                    break
                made += 1
                heapq.heappush(heap, (-int(bounds[part[0]]), -(level + 1), made, cells[part], cols[part], bounds[part]))


class Top:
    """The k best (score, id) so far: the highest scores, of equal ones the smallest ids."""

    def __init__(self, k: int):
        self.k, self.found, self.least, self.least_id = k, [], 1, None

    def may_enter(self, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        if self.least_id is None:
            return scores >= self.least
        return (scores > self.least) | ((scores == self.least) & (ids < self.least_id))

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        self.found = sorted(self.found + [(-s, i) for s, i in zip(scores.tolist(), ids.tolist())])[: self.k]
        if len(self.found) == self.k:
            self.least, self.least_id = -self.found[-1][0], self.found[-1][1]


#: Stands for a null id, which sorts first.
NO_ID = np.iinfo(np.int64).min

_SEGMENT = pa.schema([("ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("holders", pa.list_(pa.int32())), ("treap", pa.binary())])


def _segment(ids: list[int | None], numbers: Numbers, docs_terms: list[np.ndarray], docs: int, occurrences: int) -> pa.RecordBatch:
    order = np.argsort(np.array([NO_ID if i is None else i for i in ids], dtype=np.int64), kind="stable")
    lengths = np.array([len(docs_terms[i]) for i in order], dtype=np.int64)
    flat = np.concatenate([docs_terms[i] for i in order]).astype(np.int64)
    keys, tf = np.unique(np.repeat(np.arange(len(order)), lengths) * len(numbers) + flat, return_counts=True)
    cols, words = keys // len(numbers), keys % len(numbers)
    holders = np.bincount(words, minlength=len(numbers))
    by_holders = np.argsort(-holders, kind="stable")  # common terms are neighbours: dense cells
    row_of = np.empty(len(numbers), dtype=np.int64)
    row_of[by_holders] = np.arange(len(numbers))
    values = impacts(tf.astype(np.int64), lengths[cols], docs, occurrences)
    treap = K2Treap.of(row_of[words], cols, values, max(len(numbers), len(order), 2))
    names = np.array(list(numbers), dtype=object)[by_holders]
    return pa.RecordBatch.from_pylist(
        [{"ids": [ids[i] for i in order], "terms": [t.decode() for t in names], "holders": holders[by_holders].tolist(), "treap": treap.dumps()}], schema=_SEGMENT
    )


def _indexer(docs: int, occurrences: int, segment_terms: int, segment_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, numbers, found, held = [], Numbers(), [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = terms(text.as_py())
                if not words:
                    continue
                if found and (held + len(words) > segment_terms or len(found) >= segment_docs):
                    yield _segment(ids, numbers, found, docs, occurrences)
                    ids, numbers, found, held = [], Numbers(), [], 0
                ids.append(i)
                found.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words)))
                held += len(words)
        if found:
            yield _segment(ids, numbers, found, docs, occurrences)

    return run


class LexicalIndex:
    """The segments of an index, (ids, terms, holders, treap) each, and the counts that scores need.

    A segment covers some thousand documents: its columns are the documents in the order of their ids,
    its rows the segment's terms, the common ones first, each with its number of documents there.
    """

    def __init__(self, segments: DataFrame, docs: int, occurrences: int):
        self.segments, self.docs, self.occurrences = segments, docs, occurrences

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_terms: int = SEGMENT_TERMS, segment_docs: int = SEGMENT_DOCS) -> LexicalIndex:
        """Index every row of docs, whole texts. Nothing is shuffled: a task indexes the documents it reads.

        Ids are integers; a null id is an id. Rows that repeat an id are documents each. Null, empty and
        termless texts are no documents. Only the two named columns are read. Terms are counted once
        before, as the values of the cells depend on the mean length of all documents.
        """
        rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
        counted = rows.select(F.regexp_count("text", F.lit(TERM_RE)).cast("long").alias("n"))
        n, total = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        made = rows.mapInArrow(_indexer(n, total, segment_terms, segment_docs), "ids array<long>, terms array<string>, holders array<int>, treap binary")
        return cls(shared_table(made), n, total)

    def weights(self, wanted: list[str]) -> dict[str, int]:
        """The weight of each wanted term that a document holds. wanted: the terms of one block of items."""
        spark = self.segments.sparkSession
        asked = F.broadcast(spark.createDataFrame([(t,) for t in wanted], "term string"))
        pairs = self.segments.select(F.explode(F.arrays_zip("terms", "holders")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.holders").alias("n"))
        held = pairs.join(asked, "term").groupBy("term").agg(F.sum("n").alias("n")).collect()
        return {r.term: term_weight(self.docs, r.n) for r in held}

    def search(self, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
        """(item_id, rank, doc_id, score): each item's k best documents with a score above 0.

        A term of the item adds its weight times the document's impact, once. Equal scores rank by id, a
        null id first. Items without terms, null texts included, have no rows; items that repeat an id are
        items each, and their rows repeat. Items are read in blocks of BLOCK_ITEMS at most and
        BLOCK_CHARS, each sent to all segments; a task goes through its segments with
        the bound that it has reached, and hands on k rows an item.
        """
        spark = self.segments.sparkSession
        schema = f"item_id {items.schema[id_col].dataType.simpleString()}, item long, doc_id long, score long"
        found = [self._block(block, at, k, schema) for at, block in _blocks(items.select(F.col(id_col).alias("item_id"), text_or_empty(text_col).alias("text")))]
        out = spark.createDataFrame([], schema) if not found else found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

    def _block(self, block: list[tuple], first: int, k: int, schema: str) -> DataFrame:
        texts = [(key, sorted({t.decode() for t in terms(text)})) for key, text in block]
        weights = self.weights(sorted({t for _, own in texts for t in own}))
        wanted = sorted(t for t, w in weights.items() if w > 0)
        number = {t: i for i, t in enumerate(wanted)}
        asked = [np.array([number[t] for t in own if t in number], dtype=np.int64) for _, own in texts]
        searched = self.segments.select("ids", "terms", "treap").mapInArrow(
            _searcher(wanted, np.array([weights[t] for t in wanted], dtype=np.int64), asked, k), "item long, doc_id long, score long"
        )
        named = self.segments.sparkSession.createDataFrame([(key, i) for i, (key, _) in enumerate(texts)], f"{schema.split(',')[0]}, item long")
        return shared_table(searched.join(F.broadcast(named), "item").select("item_id", (F.col("item") + first).alias("item"), "doc_id", "score"))


def _blocks(items: DataFrame) -> Iterator[tuple[int, list[tuple]]]:
    """Blocks of (id, text) with the number of their first item; the rows come to the driver one block at a time."""
    block, chars, first = [], 0, 0
    for row in items.toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or chars + len(row.text) > BLOCK_CHARS):
            yield first, block
            first, block, chars = first + len(block), [], 0
        block.append((row.item_id, row.text))
        chars += len(row.text)
    if block:
        yield first, block


def _searcher(wanted: list[str], weights: np.ndarray, asked: list[np.ndarray], k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, names = [Top(k) for _ in asked], pa.array(wanted, pa.string())
        for b in batches:
            for s in range(b.num_rows):
                ids = b.column(0)[s].values.fill_null(NO_ID).to_numpy(zero_copy_only=False)
                at = pc.index_in(b.column(1)[s].values, value_set=names)
                rows = np.flatnonzero(np.asarray(at.is_valid()))
                row_of = np.full(len(wanted), -1, dtype=np.int64)
                row_of[at.drop_null().to_numpy()] = rows
                treap = K2Treap.loads(b.column(2)[s].as_py())
                for own, top in zip(asked, tops):
                    here = row_of[own]
                    if (here >= 0).any():
                        treap.best(here[here >= 0], weights[own[here >= 0]], ids, top)
        rows = [(n, None if i == NO_ID else i, -s) for n, top in enumerate(tops) for s, i in top.found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], names=["item", "doc_id", "score"])

    return run
