"""The pipeline's stage functions on odd tables: nulls, empty and long texts, repeated rows, no rows, and columns of any name."""

import pytest

from civicspark.llm.line_dedup import without_shared_lines
from civicspark.llm.mixing import mixed
from civicspark.llm.near_copies import one_of_each_group
from civicspark.llm.quality_classifier import good_documents

GOOD = "The people of the town walked to the market in the morning, and all of them had something to say about the weather of that day. "
#: Names that the operators use inside, in either case, and one that needs quoting.
EXTRA = ("__id", "__th", "__text", "__lines", "__lost", "__set", "__copies", "__copy", "salt", "id", "group", "size", "h", "score", "votes", "c0", "TEXT2", "a b.c")
SCHEMA = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
STAGES = {"good": good_documents, "lines": without_shared_lines, "near": one_of_each_group, "mixed": mixed}


def table(spark, rows):
    """rows: (doc_id, text, source); the other columns tell the row."""
    full = [(i, t, s, None if t is None else len(t), *[f"{c} {k}" if k % 3 else None for c in EXTRA]) for k, (i, t, s) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


ODD = [
    (1, GOOD, "a"), (2, None, "a"), (3, "", None), (None, GOOD + "More of it stands here for once and for all to see. " * 3, "b"), (4, "word " * 50_000, "a"),
    (5, GOOD * 3, None), (5, GOOD * 3, None), (5, "Another text of the same number, which has its own words and goes its own way. " * 2, "c"), (6, GOOD, "a"),
    (7, "one line of the many\nA Shared Line Of Text\nown words here", "a"), (8, "a shared line of text\nsomething else again", "b"), (9, "\n\n \t", "b"),
]


@pytest.mark.parametrize("name", STAGES)
def test_columns_and_values_stay(spark, name):
    docs = table(spark, ODD)
    out = STAGES[name](docs)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    given = {(r[0], *r[4:]): r for r in rows_of(docs)}
    for r in rows_of(out):
        was = given[(r[0], *r[4:])]
        assert r[2] == was[2] and (name == "lines" or r == was)


@pytest.mark.parametrize("name", STAGES)
def test_empty_table_and_only_empty_texts(spark, name):
    assert STAGES[name](table(spark, ODD).limit(0)).collect() == []
    out = STAGES[name](table(spark, [(1, None, None), (2, "", None), (None, "", "a")])).collect()
    assert len(out) == {"good": 0, "lines": 3, "near": 1, "mixed": 0}[name]


def test_good_documents_go_without_texts(spark):
    left = [(r[0], r[1]) for r in good_documents(table(spark, ODD)).collect()]
    assert all(t for _, t in left) and (1, GOOD) in left and sum(i == 5 and t == GOOD * 3 for i, t in left) == 2  # repeated rows are judged alike


def test_lines_of_nulls_and_repeats(spark):
    got = {(r.doc_id, r.text): r.n_chars for r in without_shared_lines(table(spark, ODD)).collect()}
    assert (2, "") in got and (3, "") in got and (9, "\n\n \t") in got  # null texts become empty, blank lines stay
    assert (7, ODD[9][1]) in got and (8, "something else again") in got  # the smallest id keeps the line
    assert (1, "") in got and (6, "") in got and (None, ODD[3][1]) in got or (1, GOOD) in got
    assert all(n == len(t) for (_, t), n in got.items())


def test_one_row_of_each_group(spark):
    left = [r.doc_id for r in one_of_each_group(table(spark, ODD)).collect()]
    # 6 copies 1, and GOOD three times over has 22 of its 26 runs of words; 3 and 9 have no words, as 2 has none
    assert sorted(left, key=str) == [1, 2, 4, 5, 7, 8, None]


def test_mix_of_ties_and_nulls(spark):
    out = mixed(table(spark, ODD)).collect()
    seen = {}
    for r in out:
        assert r.text and r.text.split()
        seen[(r[0], *r[4:])] = seen.get((r[0], *r[4:]), 0) + 1
    assert seen and max(seen.values()) <= 2
