"""Work in pieces of bounded bytes."""

import pyarrow as pa
from pyspark.sql import functions as F

from civicspark.functions import text
from civicspark.functions.batches import slices


def test_pieces_are_bounded_by_any_column():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 400, None, "y" * 700, "z" * 50]), pa.array(range(4))], names=["html", "id"])
    assert [(p.column(1).to_pylist(), n) for p, n in slices(batch, 1_000, 0)] == [([0, 1], 400), ([2, 3], 750)]


def test_pages_are_parsed_in_pieces(spark):
    pages = spark.range(0, 60, 1, 1).select(F.concat(F.lit("<article><a href='/"), "id", F.lit("'>n "), "id", F.lit("</a> "), F.repeat(F.lit("x"), 100_000), F.lit("</article>")).alias("html"), "id")
    out = text.main_text(pages)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r for r in out.selectExpr("id", "main_text", "links").collect()}
    assert all(got[k].main_text == f"n {k} {'x' * 100_000}" and got[k].links == [f"/{k}"] for k in range(60)) and len(got) == 60
