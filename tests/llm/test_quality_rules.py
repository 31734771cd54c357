import re
from collections import defaultdict

import pytest

from civicspark.llm.quality_rules import quality_rules

SPACE = "[\\x20\\x09-\\x0D]"


def slow(rows, line_docs, line_share, left_words=20, left_share=0.3, line_most=200):
    """rows: [(doc_id, text, source)] with distinct ids."""
    docs, holders = defaultdict(set), defaultdict(set)
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    split = lambda x: re.findall(r"[^\x20\x09-\x0D]+", x)
    for i, text, host in rows:
        docs[host].add(i)
        for x in (text or "").split("\n"):
            if split(x):
                holders[host, key(x)].add(i)
    out = {}
    for i, text, host in rows:
        text = text or ""
        w, lines = split(text), [x for x in text.split("\n") if split(x)]
        runs = defaultdict(list)
        for k in range(len(w) - 7):
            runs[tuple(w[k : k + 8])].append(k)
        repeated = {k + j for at in runs.values() if len(at) > 1 for k in at for j in range(8)}
        gone = [x for x in lines if len(holders[host, key(x)]) > max(line_docs, min(line_most, line_share * len(docs[host])))]
        left = len(w) - sum(len(split(x)) for x in gone)
        failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
        out[i] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed, len(gone), left, not failed and left >= left_words and left >= left_share * len(w))
    return out


COLS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_lines", "left_words", "kept")


@pytest.mark.parametrize("line_docs,line_share", [(5, 0.01), (2, 0.01), (1, 0.3)])
def test_whole_table(spark, line_docs, line_share):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    want = slow([tuple(r) for r in docs.collect()], line_docs, line_share)
    got = {r.doc_id: tuple(r[c] for c in COLS) for r in quality_rules(docs, line_docs=line_docs, line_share=line_share).collect()}
    assert got == want


def test_depleted_and_edge_cases(spark):
    foot = "all rights reserved by the publisher of this site and its many partners worldwide"
    own = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(6)]
    rows = [(i, f"{own[i]}\n{foot}", "a") for i in range(5)]
    rows += [(5, f"{foot}\n{foot}\n" + " ".join(f"v{j}" for j in range(19)), "a"), (6, foot + "\n" + own[5], None), (7, None, "a"), (8, "", None), (9, " ".join(["same words here"] * 4000), "b"), (None, own[0], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as n_words", "2 as kept")
    got = {r.doc_id: tuple(r[c] for c in COLS) for r in quality_rules(docs, line_docs=3).collect()}
    assert got == slow(rows, 3, 0.01)
    assert got[0][-1] and not got[5][-1] and got[6][-3] == 0 and got[9][4] == 12_000
    assert quality_rules(docs.limit(0)).count() == 0


def test_repeated_rows_count_once(spark):
    line = " ".join(f"w{j}" for j in range(40))
    docs = spark.createDataFrame([(1, line, "a")] * 5 + [(2, line, "a")], "doc_id long, text string, source string")
    got = quality_rules(docs, line_docs=2).collect()
    assert len(got) == 6 and all(r.kept for r in got)


def test_the_limit_stops_rising_with_the_host(spark):
    foot = "all rights reserved by the publisher of this site"
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30)) + (f"\n{foot}" if i < 60 else ""), "a") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for most, removed in ((200, 0), (59, 60), (60, 0)):
        got = {r.doc_id: tuple(r[c] for c in COLS) for r in quality_rules(docs, line_share=0.5, line_most=most).collect()}
        assert got == slow(rows, 5, 0.5, line_most=most) and sum(r[6] for r in got.values()) == removed


def test_the_rules_act_on_the_given_tables(spark):
    got = quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("removed_lines > 0")
    assert got.count() > 50


def test_very_long_texts(spark):
    rows = [(1, "one of the very many words " * 60_000, "a"), (2, "\n".join(f"line {i} of the long text" for i in range(40_000)), "a"), (3, "x" * 3_000_000, "b"), (4, None, None)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].base_failed) == (360_000, 360_000, True)
    assert (got[2].n_words, got[2].n_dup_lines, got[2].n_repeat_words) == (240_000, 0, 0) and got[2].kept
    assert (got[3].n_words, got[3].word_chars, got[3].base_failed) == (1, 3_000_000, True) and got[4].n_words == 0
