"""Bounded-space best-fit packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import shared_table, text_or_empty

#: Bins that a packer holds open.
OPEN_BINS = 64
#: Pieces that one packer gets in the mean.
PER_PACKER = 4096
#: Bytes of chunks and their ids that a Python worker remembers, what Python adds to each included; past it the memory starts anew.
MEMO_BYTES = 192 << 20
#: What Python needs for a remembered chunk besides its characters and ids.
MEMO_EACH = 250


class Memo(dict):
    """Chunks with their ids, at most `limit` bytes of them: a full memory is emptied."""

    def __init__(self, limit: int = MEMO_BYTES):
        super().__init__()
        self.limit, self.used = limit, 0

    def keep(self, found: dict[str, bytes]) -> None:
        cost = MEMO_EACH * len(found) + 4 * sum(map(len, found)) + sum(map(len, found.values()))
        if self.used + cost > self.limit:
            self.clear()
            self.used = 0
        if cost <= self.limit:
            self.update(found)
            self.used += cost


class ChunkTokenizer:
    """Ids of whole texts, with the ids of their space-separated chunks remembered.

    Before it merges bytes, the tokenizer cuts a text at every single space that has no white space
    beside it, so the ids of a text are those of its chunks in a row, where a chunk starts with its space.
    White space of any other shape stays inside a chunk. A text that holds an added token is encoded whole.
    """

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        vocab = self._tokenizer.get_vocab()
        self._opens = np.zeros(max(vocab.values()) + 1, dtype=bool)  # ids that begin with a space
        self._opens[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        self._memo = Memo(memo_bytes)
        self._model = self._tokenizer.model
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
        self._letters = {b: chr(256 + k) for k, b in enumerate(odd)}  # the model writes bytes as letters
        self._heads, self._marks = Memo(memo_bytes // 8), Memo(memo_bytes // 8)

    #: Letters, and then characters that are neither letters, digits nor white space: the tokenizer cuts between.
    _PARTS = re.compile(r"([^\W\d_]+)([^\w\s]*)")

    def _letters_ids(self, letters: str) -> bytes:
        """Ids of letters with or without a space before them: one piece for the model, which needs no cutting."""
        piece = letters.encode().decode("latin-1").translate(self._letters)
        return array("I", [t.id for t in self._model.tokenize(piece)]).tobytes()

    def _remembered(self, memo: Memo, key: str, make) -> bytes:
        ids = memo.get(key)
        if ids is None:
            memo.keep({key: (ids := make(key))})
        return ids

    def _simple(self, chunk: str, after_space: bool) -> bytes | None:
        """Ids of letters and then marks; None for chunks of another shape."""
        m = self._PARTS.fullmatch(chunk)
        if not m or not m[1].isalpha():
            return None
        if after_space:
            ids = self._memo.get(m[1]) or self._letters_ids(f" {m[1]}")
        else:
            ids = self._remembered(self._heads, m[1], self._letters_ids)
        return ids + self._remembered(self._marks, m[2], lambda x: self._encode(x).tobytes()) if m[2] else ids

    def _lines(self, chunk: str) -> bytes | None:
        """Ids of two simple chunks with a line break between them; None for others."""
        left, _, right = chunk.partition("\n")
        a, b = self._simple(left, True), self._simple(right, False)
        return None if a is None or b is None else a + self._remembered(self._marks, "\n", lambda x: self._encode(x).tobytes()) + b

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks without white space at their ends; each stands after a space."""
        found, rest = {}, []
        for c in chunks:
            ids = self._simple(c, True) or ("\n" in c and self._lines(c))
            if ids:
                found[c] = ids
            else:
                rest.append(c)
        if rest:
            ids = self._encode(" " + " ".join(rest))
            starts = np.flatnonzero(self._opens[ids])
            if len(starts) == len(rest):
                data, at = ids.tobytes(), (4 * starts).tolist()
                found.update(zip(rest, (data[i:j] for i, j in zip(at, [*at[1:], len(data)]))))
            else:
                found.update((c, self._encode(f" {c}").tobytes()) for c in rest)
        return found

    def ids(self, text: str) -> bytes:
        """The ids as unsigned 32-bit little-endian integers."""
        if any(t in text for t in self._added):
            return self._encode(text).tobytes()  # an added token is one id wherever it stands
        first, *chunks = text.split(" ")
        got = list(map(self._memo.get, chunks))
        new = list({c for c, x in zip(chunks, got) if x is None}) if None in got else []
        if first[-1:].isspace() or not (first or not text) or any(not c or c[0].isspace() or c[-1].isspace() for c in new):
            return self._encode(text).tobytes()  # white space of another shape: no cut
        if new:
            found = self._learn(new)
            self._memo.keep(found)
            got = [found[c] if x is None else x for c, x in zip(chunks, got)]
        head = self._simple(first, False) or self._encode(first).tobytes() if first else b""
        return head + b"".join(got)


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences, and before them what is left over."""
    first = n % length or min(n, length)
    return [(0, first), *[(at, length) for at in range(first, n, length)]]


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, length: int, end_id: int) -> DataFrame:
    """(id, copy, piece, start, length, ids_crc32): the pieces of every row of docs.

    copy is the hash of the text, which tells rows of one id apart where the texts differ.
    """
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    base = base.select("id", F.xxhash64("text").alias("copy"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _TOKENIZERS.get(tokenizer) or _TOKENIZERS.setdefault(tokenizer, ChunkTokenizer(tokenizer))
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            row, out = [], []
            for r, text in enumerate(batch.column(2).to_pylist()):
                data = tok.ids(text) + end
                for k, (at, n) in enumerate(cut(len(data) // 4, length)):
                    row.append(r)
                    out.append((k, at, n, zlib.crc32(data[4 * at : 4 * (at + n)])))
            cols = np.array(out, dtype=np.int64).reshape(-1, 4)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(cols[:, 0].astype(np.int32)), *[pa.array(cols[:, k]) for k in (1, 2, 3)]],
                names=["id", "copy", "piece", "start", "length", "ids_crc32"],
            )

    return base.mapInArrow(run, f"id {kind}, copy long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], size: int, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int]]:
    """(bin, offset) of each item, in the given order: online best fit with a bounded number of open bins.

    Bit s of a bitset tells that an open bin has s free; the lowest set bit from an item's length on is
    the fullest bin that takes it. When a new bin is needed and open_bins are open, the fullest closes.
    """
    free_bits, stacks = 0, [[] for _ in range(size + 1)]
    n_bins = n_open = 0
    bins, offsets = [], []
    for n in lengths:
        fits = free_bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = stacks[free].pop()
        else:
            if n_open >= open_bins:
                fullest = (free_bits & -free_bits).bit_length() - 1
                stacks[fullest].pop()
                n_open -= 1
                if not stacks[fullest]:
                    free_bits &= ~(1 << fullest)
            free, b = size, n_bins
            n_bins += 1
            n_open += 1
        bins.append(b)
        offsets.append(size - free)
        if free < size and not stacks[free]:
            free_bits &= ~(1 << free)
        left = free - n
        if left:
            stacks[left].append(b)
            free_bits |= 1 << left
        else:
            n_open -= 1
    return bins, offsets


def _pack(size: int, open_bins: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "copy", "ids_crc32", "start"], kind="stable").reset_index(drop=True)  # as they come: no order of lengths
        bins, offsets = best_fit(rows["length"].tolist(), size, open_bins)
        return rows.assign(sequence_id=rows["packer"].astype("int64") * (1 << 40) + np.array(bins, dtype=np.int64), offset=np.array(offsets, dtype=np.int64))[
            ["id", "copy", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        ]

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 1024,
    end_id: int = 2,
    open_bins: int = OPEN_BINS,
    per_packer: int = PER_PACKER,
) -> DataFrame:
    """Pack every row of docs into sequences of at most length ids.

    Returns (id_col, piece, start, length, ids_crc32, sequence_id, offset), one row per piece. A document
    is its ids and then end_id; a longer one is cut into pieces of `length` ids, of which the first may be
    shorter. Null and empty texts are the end id alone. A null id is kept; rows that repeat an id are
    packed each for itself. An empty table gives an empty result. Only the two named columns are read.

    Whole sequences need no packer. The others, whose rows are a few numbers each, are dealt by hash to
    packers of about per_packer pieces, each of which runs bounded-space best fit online: pieces come in
    the order of their hash, whatever their length, and the number of open bins does not grow with them.
    """
    table = shared_table(pieces(docs, tokenizer, id_col, text_col, length, end_id))
    part = F.col("length") < length
    packers = max(1, -(-table.where(part).count() // per_packer))
    order = F.xxhash64("copy", "id", "ids_crc32", "start")
    dealt = table.where(part).withColumn("order", order).withColumn("packer", F.pmod(F.shiftrightunsigned("order", 20), F.lit(packers)).cast("int"))
    kind = table.schema["id"].dataType.simpleString()
    schema = f"id {kind}, copy long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = dealt.groupBy("packer").applyInPandas(_pack(length, open_bins), schema)
    whole = table.where(~part).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(whole).select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
