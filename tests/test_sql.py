"""The engine's functions in SQL give what its operators give."""

import pytest
from pyspark.sql import functions as F

from civicspark import sql
from civicspark.functions.geo import haversine_m
from civicspark.operators.tagging import text_hits


def test_lateral_hits_are_those_of_the_operator(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    names = docs.select(F.explode(F.split("text", " ")).alias("name")).where("length(name) > 3").distinct().where(F.xxhash64("name") % 7 == 0)
    names = names.withColumn("mask", (1 + F.pmod(F.xxhash64("name"), F.lit(3))).cast("int")).cache()
    sql.register(spark, names)
    docs.createOrReplaceTempView("docs")
    columns = "doc_id, name, mask, start, length, is_longest, tail"
    got = spark.sql(f"select {columns} from docs, lateral text_hits(text)").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, text_hits(docs, names).select(columns.split(", ")).collect())) and len(got) > 300


def test_functions(spark):
    sql.register(spark)
    points = spark.createDataFrame([(13.1, 52.5, 13.4, 52.4), (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 180.0, 0.0), (None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    points.createOrReplaceTempView("points")
    got = spark.sql("select haversine_m(a, b, c, d), degrees_between(a, b, c, d) from points").collect()
    want = points.select(haversine_m(*[F.col(c) for c in "abcd"])).collect()
    assert [r[0] for r in got] == [pytest.approx(w[0]) if w[0] is not None else None for w in want] and got[0][1] == pytest.approx(0.1**0.5)
