"""Chat formatting: conversations rendered by a template, tokens and loss masks aligned by offsets."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import text_or_empty

START, END = "<|im_start|>", "<|im_end|>"
#: The role whose texts are learned.
LEARNED = "assistant"
#: A conversation is rendered in one part up to this many characters; a longer one is cut between turns.
PART_CHARS = 1 << 20
#: Characters and parts that are encoded at a time.
BATCH_CHARS, BATCH_PARTS = 1 << 21, 1024

_OPENS = re.compile(r"<(\\*)\|")
_OPENED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    """text without any control string: `<|` becomes `<\\|`, and what looks so already gets one more backslash."""
    return _OPENS.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _OPENED.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    """A role on one line: backslashes are doubled and line breaks written as `\\n` before control strings are escaped."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: Iterable[tuple[str, str]]) -> tuple[str, list[str], list[int], list[int]]:
    """The formatted text of (role, text) turns; the turns' roles and where their escaped texts start and end."""
    pieces, roles, starts, ends, at = [], [], [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        pieces += [head, body, END, "\n"]
        roles.append(role)
        starts.append(at + len(head))
        ends.append(at + len(head) + len(body))
        at = ends[-1] + len(END) + 1
    return "".join(pieces), roles, starts, ends


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("not a formatted conversation")
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return turns


def learned_tokens(starts: np.ndarray, ends: np.ndarray, span_starts: np.ndarray, span_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one token of each span of characters, by binary search in the sorted token offsets.

    A token that only partly lies in a span belongs to it; an empty span has none.
    """
    first = np.searchsorted(ends, span_starts, side="right")
    last = np.searchsorted(starts, span_ends, side="left")
    return first, np.where(span_ends > span_starts, np.maximum(first, last), first)


def learned_text(formatted: str, starts: np.ndarray, ends: np.ndarray, first: int, last: int, span: tuple[int, int]) -> str:
    """What tokens first to last - 1 cover of the span, each character once: tokens of parts of a character have equal offsets."""
    if first == last:
        return ""
    a, b = np.maximum(starts[first:last], span[0]), np.minimum(ends[first:last], span[1])
    seen = np.concatenate([a[:1], np.maximum.accumulate(b)[:-1]])
    a = np.maximum(a, seen)
    if (a == seen).all():
        return formatted[a[0] : b.max()]
    return "".join(formatted[i:j] for i, j in zip(a.tolist(), b.tolist()) if j > i)


def chat_tokenizer(path: str):
    """The tokenizer with the template's control strings as tokens of their own; offsets are code points."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(s, normalized=False, special=True) for s in (START, END)])
    return tokenizer


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first_token", pa.int32()), ("end_token", pa.int32())])
_PART_FIELDS = (
    "part long, whole boolean, formatted string, roles array<string>, turn_start array<int>, turn_end array<int>, input_ids array<int>,"
    " token_start array<int>, token_end array<int>, loss_mask array<boolean>, loss_spans array<struct<start:int,end:int,first_token:int,end_token:int>>"
)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else [], type=kind))


def _encoded(tokenizer, parts: list[tuple]) -> pa.RecordBatch:
    """parts: (conv_id, part, whole, turns)."""
    rendered = [render(turns) for *_, turns in parts]
    ids, starts, ends, masks, spans, span_counts = [], [], [], [], [], [0]
    for (text, roles, turn_starts, turn_ends), e in zip(rendered, tokenizer.encode_batch([r[0] for r in rendered], add_special_tokens=False)):
        at = np.array(e.offsets, dtype=np.int32).reshape(-1, 2)
        s, t = np.ascontiguousarray(at[:, 0]), np.ascontiguousarray(at[:, 1])
        learned = np.array([r == LEARNED for r in roles], dtype=bool)
        a, b = np.array(turn_starts, dtype=np.int32)[learned], np.array(turn_ends, dtype=np.int32)[learned]
        first, last = learned_tokens(s, t, a, b)
        steps = np.zeros(len(s) + 1, dtype=np.int32)
        np.add.at(steps, first, 1)
        np.add.at(steps, last, -1)
        ids.append(np.array(e.ids, dtype=np.int32))
        starts.append(s)
        ends.append(t)
        masks.append(np.cumsum(steps[:-1]) > 0)
        spans.append(np.stack([a, b, first.astype(np.int32), last.astype(np.int32)], axis=1))
        span_counts.append(len(a))
    flat = np.concatenate(spans).T
    span_array = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat], fields=list(_SPAN))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([p[0] for p in parts], pa.int64()),
            pa.array([p[1] for p in parts], pa.int64()),
            pa.array([p[2] for p in parts], pa.bool_()),
            pa.array([r[0] for r in rendered], pa.string()),
            pa.array([r[1] for r in rendered], pa.list_(pa.string())),
            pa.array([r[2] for r in rendered], pa.list_(pa.int32())),
            pa.array([r[3] for r in rendered], pa.list_(pa.int32())),
            _lists(ids, pa.int32()),
            _lists(starts, pa.int32()),
            _lists(ends, pa.int32()),
            _lists(masks, pa.bool_()),
            pa.ListArray.from_arrays(pa.array(np.cumsum(span_counts).astype(np.int32)), span_array),
        ],
        names=["conv_id", "part", "whole", "formatted", "roles", "turn_start", "turn_end", "input_ids", "token_start", "token_end", "loss_mask", "loss_spans"],
    )


def _parts(rows: Iterator[tuple], part_chars: int) -> Iterator[tuple]:
    """(conv_id, number, whole, turns) of rows (conv_id, role, text) in order; whole: no other part can hold more of the conversation."""
    number, conv, turns, chars, alone = 0, None, [], 0, False  # the first conversation may have begun in another task
    for key, role, text in rows:
        if turns and (key != conv or chars + len(text) > part_chars):
            ends = key != conv
            yield conv, number, alone and ends, turns
            number, turns, chars, alone = number + 1, [], 0, ends
        conv = key
        turns.append((role, text))
        chars += len(role) + len(text)
    if turns:
        yield conv, number, False, turns


def _formatter(path: str, part_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, base = chat_tokenizer(path), TaskContext.get().partitionId() << 33
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
        held, chars = [], 0
        for conv, number, whole, turns in _parts(rows, part_chars):
            held.append((conv, base + number, whole, turns))
            chars += sum(len(t) for _, t in turns)
            if chars > BATCH_CHARS or len(held) >= BATCH_PARTS:
                yield _encoded(tokenizer, held)
                held, chars = [], 0
        if held:
            yield _encoded(tokenizer, held)

    return run


def format_conversations(
    conversations: DataFrame,
    tokenizer: str,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """Conversations in the chat template, each encoded once, with masks of the tokens to learn.

    Returns (conv_id, part, whole, formatted, roles, turn_start, turn_end, input_ids, token_start, token_end,
    loss_mask, loss_spans). Turns are `<|im_start|>role\\ntext<|im_end|>\\n`; control strings inside texts and
    roles are escaped so that read_turns() gives them back. Offsets are code points of `formatted`. loss_mask
    marks the tokens that hold a character of an assistant text; loss_spans names each assistant text's
    characters and tokens, as a token may also hold characters outside.

    Rows are dealt by ranges of conversation and turn, so a conversation of any length is spread over tasks.
    One that begins and ends in a task and has at most part_chars characters is one row, whole = true;
    others are several rows, in the order of `part`, cut between turns. A turn starts with a token of its
    own, so the ids and masks of the parts in a row are those of the conversation encoded at once.

    Null roles and texts are empty ones; null turns come first; rows of one turn come in the order of a
    hash of role and text, repeated ones each. Null ids are one conversation. Ids are integers. An empty
    table gives an empty result. Only the four named columns are read.
    """
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), role.alias("role"), text.alias("text"), F.col(turn_col).alias("turn"))
    rows = rows.withColumn("tie", F.xxhash64("role", "text"))
    ranges = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "tie"]
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("conv_id", "role", "text")
    return dealt.mapInArrow(_formatter(tokenizer, part_chars), f"conv_id long, {_PART_FIELDS}")


_DIGESTS = (
    "conv_id long, part long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, turns_bytes binary, loss_bytes binary"
)


def _read_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each part says when read: digests of whole conversations, the bytes to digest of others."""
    for b in batches:
        column = {name: b.column(i) for i, name in enumerate(b.schema.names)}
        convs, numbers, wholes = (column[c].to_pylist() for c in ("conv_id", "part", "whole"))
        bounds = [np.asarray(column[c].offsets) for c in ("token_start", "loss_spans")]
        starts, ends = (column[c].values.to_numpy() for c in ("token_start", "token_end"))
        spans = np.stack([column["loss_spans"].values.field(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1).reshape(-1, 4)
        out = []
        for k, formatted in enumerate(column["formatted"]):
            formatted = formatted.as_py()
            s, e = (x[bounds[0][k] : bounds[0][k + 1]] for x in (starts, ends))
            turns = read_turns(formatted)
            learned = [unescape(learned_text(formatted, s, e, f, t, (a, z))) for a, z, f, t in spans[bounds[1][k] : bounds[1][k + 1]].tolist()]
            said, learned = "".join(f"{r}\n{t}\n" for r, t in turns).encode(), "".join(learned)
            row = (convs[k], numbers[k], len(turns))
            if wholes[k]:
                row += (hashlib.sha256(said).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted), None, None)
            else:
                row += (None, len(learned), None, len(formatted), said, learned.encode())
            out.append(row)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out), kinds)] if out else [pa.nulls(0, k) for k in kinds], names=[f.split()[0] for f in _DIGESTS.split(", ")])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation of parts in order; a conversation's bytes pass through, none are held."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def done(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    open_one = None  # [conv, turns, digest of turns, characters, digest of characters, formatted]

    def closed() -> tuple:
        conv, n, said, chars, learned, formatted = open_one
        return conv, n, said.hexdigest(), chars, learned.hexdigest(), formatted

    for b in batches:
        rows = []
        for conv, _, n, turns_sha, chars, loss_sha, formatted, said, learned in zip(*[c.to_pylist() for c in b.columns]):
            if open_one is not None and (turns_sha is not None or open_one[0] != conv):
                rows.append(closed())
                open_one = None
            if turns_sha is not None:
                rows.append((conv, n, turns_sha, chars, loss_sha, formatted))
                continue
            if open_one is None:
                open_one = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            open_one[1] += n
            open_one[2].update(said)
            open_one[3] += chars
            open_one[4].update(learned)
            open_one[5] += formatted
        if rows:
            yield done(rows)
    if open_one is not None:
        yield done([closed()])


def digests(parts: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read back from format_conversations().

    turns_sha256 digests role, \\n, text, \\n per turn, loss_sha256 the unescaped characters under the mask. Where a
    conversation is whole, only its digests move; the others' parts meet in order and stream through.
    """
    used = parts.select("conv_id", "part", "whole", "formatted", "token_start", "token_end", "loss_spans")
    read = used.mapInArrow(_read_parts, _DIGESTS)
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_joined, schema)
