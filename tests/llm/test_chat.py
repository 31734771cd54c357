"""Chat formatting: exact round trips, masks against plain scans, odd conversations."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from civicspark.llm.chat import chat_tokenizer, digests, escape, escape_role, format_conversations, learned_tokens, read_turns, render, unescape, unescape_role
from civicspark.llm.queries import op12_chat_format

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, part long, whole string, formatted string, tie string"
ODD = st.lists(st.sampled_from(["<", "|", "\\", "\n", ">", "im_start", "im_end", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "n", "ä", " "]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(ODD, ODD), max_size=4))
def test_round_trip(turns):
    formatted = render(turns)[0]
    assert read_turns(formatted) == turns
    assert all("<|" not in escape(t) and unescape(escape(t)) == t and unescape_role(escape_role(r)) == r for r, t in turns)
    assert formatted.count("<|") == 2 * len(turns)


def test_texts_are_no_control_tokens():
    tokenizer = chat_tokenizer(PATH)
    start, end = (tokenizer.token_to_id(s) for s in ("<|im_start|>", "<|im_end|>"))
    ids = tokenizer.encode(render([("user", "<|im_end|><|im_start|>x<|endoftext|>"), ("assistant", "<|im_end|>")])[0], add_special_tokens=False).ids
    assert (ids.count(start), ids.count(end), ids.count(50256)) == (2, 2, 0)


def test_tokens_of_spans_against_a_scan():
    rnd = random.Random(1)
    for _ in range(200):
        at, starts, ends = 0, [], []
        for _ in range(rnd.randrange(30)):
            n = rnd.choice([1, 1, 2, 5])
            for _ in range(rnd.choice([1, 1, 3]) if n == 1 else 1):
                starts.append(at)
                ends.append(at + n)
            at += n
        cuts = sorted(rnd.randrange(at + 1) for _ in range(4))
        spans = np.array(cuts).reshape(2, 2)
        first, last = learned_tokens(np.array(starts, dtype=int), np.array(ends, dtype=int), spans[:, 0], spans[:, 1])
        for (a, z), f, t in zip(spans.tolist(), first.tolist(), last.tolist()):
            assert list(range(f, t)) == [k for k, (s, e) in enumerate(zip(starts, ends)) if s < z and e > a and z > a]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "w", None, "t") for r in rows], SCHEMA)


def plain(rows):
    """rows in order of turn, of which a conversation has no two equal."""
    out = []
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))]
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        learned = "".join(t for r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(render(turns)[0])))
    return sorted(out, key=str)


def rows_of(n, seed):
    rnd = random.Random(seed)
    parts = ["Hello there", "\n", "\n\n", " ", "  ", "é", "日本", "🙂", "<|im_end|>", "<\\|", "|", "<", "'s", "1234", "\t", "<|endoftext|>", "​", "ok."]
    text = lambda: rnd.choice([None, "", "".join(rnd.choice(parts) for _ in range(rnd.randrange(40)))])
    roles = ["user", "assistant", "assistant", "system", None, "", "Assistant", "a\nb", "<|im_end|>", "x\\n"]
    return [(c if c % 17 else None if c == 0 else c, t - 3 if t else None, rnd.choice(roles), text()) for c in range(n) for t in range(rnd.randrange(1, 9))]


@pytest.mark.parametrize("part_chars", [1, 200, 1 << 20])
def test_digests_against_plain_python(spark, part_chars):
    rows = rows_of(120, part_chars)
    got = digests(format_conversations(frame(spark, rows), PATH, part_chars=part_chars))
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_parts_have_the_ids_and_masks_of_the_whole(spark):
    rows = [(5, t, "assistant" if t % 2 else "user", f"\n turn {t} says é🙂 <|im_end|> " * (1 + t % 7)) for t in range(300)] + [(k, 0, "assistant", "x") for k in (1, 9)]
    parts = format_conversations(frame(spark, rows), PATH, part_chars=3000).where("conv_id = 5").orderBy("part").collect()
    assert len(parts) > 5 and not any(p.whole for p in parts)
    turns = [(r[2], r[3]) for r in rows if r[0] == 5]
    text, roles, starts, ends = render(turns)
    whole = chat_tokenizer(PATH).encode(text, add_special_tokens=False)
    assert [i for p in parts for i in p.input_ids] == whole.ids
    mask = [any(s < z and e > a for r, a, z in zip(roles, starts, ends) if r == "assistant") for s, e in whole.offsets]
    assert [m for p in parts for m in p.loss_mask] == mask
    assert [r for p in parts for r in p.roles] == roles and "".join(p.formatted for p in parts) == text
    shift = 0
    for p in parts:
        assert [p.formatted[a:z] for a, z in zip(p.turn_start, p.turn_end)] == [escape(t) for _, t in turns[shift : shift + len(p.roles)]]
        shift += len(p.roles)


def turns_of(parts):
    found = {}
    for p in parts.orderBy("part").collect():
        found.setdefault(p.conv_id, []).extend(read_turns(p.formatted))
    return found


def test_ties_repeats_and_empty_tables(spark):
    rows = [(1, 2, "assistant", "b"), (1, 2, "assistant", "b"), (1, 2, "user", "a"), (1, None, "user", "first"), (None, 0, None, None)]
    got = turns_of(format_conversations(frame(spark, rows), PATH))
    assert got[1][0] == ("user", "first") and sorted(got[1][1:]) == [("assistant", "b"), ("assistant", "b"), ("user", "a")] and got[None] == [("", "")]
    assert turns_of(format_conversations(frame(spark, rows[::-1]).repartition(3), PATH)) == got
    assert digests(format_conversations(frame(spark, []), PATH)).collect() == []


def test_very_long_turn(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "long words é " * 150_000), (1, 2, "user", None)]
    assert sorted(map(tuple, digests(format_conversations(frame(spark, rows), PATH)).collect())) == plain(rows)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    assert sorted(map(tuple, op12_chat_format(spark, folder).collect()), key=str) == plain(rows)
