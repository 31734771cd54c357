import pytest

from civicspark.llm.line_dedup import line_dedup


def run(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, pos int")
    return sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup(docs, **kw).collect()), key=str)


def test_first_holder_keeps_its_lines(spark):
    rows = [(2, "Common line here\nown\nCommon line here", None, 1), (5, " COMMON LINE HERE\t\nmine\n", None, 2), (7, "short\nshort", None, 3), (8, "short", None, 4)]
    assert run(spark, rows) == sorted([(2, rows[0][1], 3, 0), (5, "mine\n", 3, 1), (7, "short\nshort", 2, 0), (8, "short", 1, 0)], key=str)


def test_nulls_repeats_and_empty_tables(spark):
    line = "a line of some length"
    rows = [(None, line, "x", 1), (1, line, "x", 2), (3, None, None, None), (4, "", None, None), (6, "twice the same line\ntwice the same line", None, 5), (6, "twice the same line", None, 6)]
    want = [(None, line, 1, 0), (1, "", 1, 1), (3, "", 1, 0), (4, "", 1, 0), (6, rows[4][1], 2, 0), (6, rows[5][1], 1, 0)]
    assert run(spark, rows) == sorted(want, key=str)
    assert run(spark, []) == []


def test_case_is_folded_for_ascii_only_and_space_is_ascii(spark):
    rows = [(1, "Était une fois", None, 1), (2, "était une fois", None, 1), (3, " était une fois", None, 1), (4, "ALL LOWER NOW\r", None, 1), (5, "all lower now", None, 1)]
    got = {r[0]: r[3] for r in run(spark, rows)}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}


@pytest.mark.parametrize("min_docs,dropped", [(2, 2), (3, 2), (4, 0)])
def test_min_docs(spark, min_docs, dropped):
    rows = [(i, "the shared line of all\nrest " + "x" * i, None, 0) for i in (3, 1, 2)]
    assert sum(r[3] for r in run(spark, rows, min_docs=min_docs)) == dropped


def test_very_long_text(spark):
    text = "\n".join(f"line number {i} of many" for i in range(30_000))
    got = run(spark, [(1, text, None, 0), (2, text, None, 0), (3, text + "\nlast one is new", None, 0)])
    assert [(r[0], r[2], r[3]) for r in got] == [(1, 30_000, 0), (2, 30_000, 30_000), (3, 30_001, 30_000)]
    assert got[2][1] == "last one is new"
