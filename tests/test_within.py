"""Radii around locations: what a pair costs, and what is left of a batch."""

import os
import random

from pyspark.sql import functions as F

from civicspark import storage
from civicspark.functions.geo import GEOMETRY
from civicspark.operators import spatial


def _shapes(spark):
    rows = [(i, 13 + i * 0.001, 52.5, ("LineString", [("line", 0, 0, [(13 + i * 0.001, 52.5), (13.06 + i * 0.001, 52.5 + 0.02 * (i % 9 == 0))])]) if i % 3 else None) for i in range(60)]
    return spark.createDataFrame(rows, f"id long, lng double, lat double, geometry {GEOMETRY}")


def _places(spark):
    rnd = random.Random(2)
    rows = [(u, 13 + rnd.random() * 0.1, 52.48 + rnd.random() * 0.04, rnd.choice([300, 2000, 8000])) for u in range(50)]
    return spark.createDataFrame(rows, "user_id long, q_lng double, q_lat double, radius_m int")


def test_pairs_of_boxes_are_told_without_a_look_at_shapes(spark):
    """Only shapes that are not their box have their points looked at; the plan of the others has no step over them for each pair."""
    places, items = _places(spark), _shapes(spark)
    plan = spatial.within_metres(places, items.where("id % 9 > 0")).select("user_id", "id")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert any("radius_m" in line and "Join" in line for line in plan) and not [line for line in plan if "Join" in line and "lambda" in line], plan
    d = F.coalesce(spatial.distance_m(F.col("geometry"), F.col("q_lng"), F.col("q_lat")), spatial.haversine_m(F.col("q_lng"), F.col("q_lat"), F.col("lng"), F.col("lat")))
    want = {(r.user_id, r.id) for r in places.crossJoin(items).where(d <= F.col("radius_m")).collect()}
    got = [(r.user_id, r.id) for r in spatial.within_metres(places, items).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200


def test_tables_of_a_batch_are_deleted(spark):
    lasting = storage.shared_folder(spark, "lasting")
    spark.range(3).write.parquet(lasting)
    with storage.tables_of_a_batch(spark):
        made = storage.shared_table(spark.range(5)).inputFiles()
        assert made and os.path.exists(made[0].removeprefix("file:"))
    assert not os.path.exists(made[0].removeprefix("file:")) and os.path.exists(lasting)
