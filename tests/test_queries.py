"""Every registered query of the engine against its SQL on the smallest tables, and the shape of plans."""

import html
import importlib
import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from civicspark.plans import feed_queries, item_queries, spatial_queries, text_queries

DATA = "/root/testdata/sf0.001"
MODULES = (spatial_queries, text_queries, feed_queries, item_queries)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: q for m in MODULES for name, q in m.ORACLES.items()}


def test_names_are_given_once():
    assert len(QUERIES) == sum(len(m.QUERIES) for m in MODULES) and set(ORACLES) <= set(QUERIES)


def rows(frame, columns):
    return sorted(tuple("~" if v is None or v != v else str(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_main_text_against_a_plain_reading(spark):
    """The one query without SQL: what stands between the article's tags, by regular expressions."""
    assert set(QUERIES) - set(ORACLES) == {"main_text"}
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = {r.page_id: r for r in QUERIES["main_text"](spark, DATA).collect()}
    assert got.keys() == pages.keys()
    for i, page in pages.items():
        inner = "".join(re.findall(r"(?s)<article\b[^>]*>(.*?)</article>", page))
        inner = re.sub(r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->", "", inner)
        plain = html.unescape(re.sub(r"<[^>]*>", "", inner))
        assert got[i].main_text.split() == plain.split() and got[i].n_links == len(re.findall(r"<a\b[^>]*\bhref=[\"'][^\"']", page))


def test_without_the_training_data_operators(tmp_path):
    """A copy without the subpackage and the pipeline still registers all other queries; without the pipeline alone it is an error."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "civicspark", tmp_path / "civicspark")
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}  # which may lead to the whole repository
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    if (root / "civicspark" / "llm").is_dir():
        assert "corpus_pipeline" in run().stderr
        shutil.rmtree(tmp_path / "civicspark" / "llm")
    assert run().stdout.split()[-2:] == [str(len(QUERIES)), str(len(ORACLES))]


def test_entry_module_imports(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["near_topk", "near_relevance", "radius_alerts", "feed_entries", "search_prefix", "search_contains", "upsert_snapshot", "near_news", "near_both_kinds", "subscription_events", "feed_gazette_sections"])
def test_plans_have_no_nested_loops_and_no_python(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan and "Pandas" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["radius_alerts"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "GreaterThanOrEqual(o_orderdate" in plan
