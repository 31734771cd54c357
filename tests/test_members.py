"""Filters of bits, and long shapes of news that are met by their pieces."""

import random

from pyspark.sql import functions as F

from civicspark import storage
from civicspark.functions.geo import GEOMETRY
from civicspark.operators import spatial
from civicspark.operators.members import likely_in


def test_rows_of_some_keys_stay_and_few_others(spark):
    some = storage.shared_table(spark.range(40).select((F.col("id") * 977 - 300).alias("id")))
    left = {r.id for r in likely_in(spark.range(-1000, 40_000), "id", some).collect()}
    assert left >= {r.id for r in some.collect()} and len(left) < 200
    assert likely_in(spark.range(1000), "id", some.limit(0)).count() == 0


def test_long_shapes_of_news_are_met_by_their_pieces(spark):
    rnd = random.Random(3)
    news, brute = [], {}
    for i in range(200):
        x, y, w, h = 13 + rnd.random() * 0.1, 52 + rnd.random() * 0.1, *rnd.choice([(0.04, 0.0), (0.0, 0.03), (0.02, 0.02), (0.0, 0.0)])
        ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
        shape = ("Polygon", [("polygon", 0, 0, ring)]) if w and h else ("LineString", [("line", 0, 0, [ring[0], ring[2]])])
        point = (13 + rnd.random() * 0.1, 52 + rnd.random() * 0.1) if i % 3 else None
        news.append((i, False, [point] if point else None, [shape] if i % 4 else [shape, None]))
        far = lambda q, r, x=x, y=y, w=w, h=h, p=point: min(((max(x - q, 0, q - x - w)) ** 2 + (max(y - r, 0, r - y - h)) ** 2) ** 0.5, ((p[0] - q) ** 2 + (p[1] - r) ** 2) ** 0.5 if p else 9)
        brute[i] = far
    table = spark.createDataFrame(news, f"id long, hidden boolean, geo_points array<struct<lng:double,lat:double>>, geometries array<{GEOMETRY}>")
    places = [(q, 13 + rnd.random() * 0.1, 52 + rnd.random() * 0.1) for q in range(20)]
    got = {(r.query_id, r.near_rank): r.id for r in spatial.nearest_news(spark.createDataFrame(places, "query_id long, q_lng double, q_lat double"), table, 7).collect()}
    want = {(q, n + 1): i for q, x, y in places for n, (d, i) in enumerate(sorted((f(x, y), i) for i, f in brute.items())[:7]) if d <= 0.05}
    assert got == want
    pieces = spatial._cut(table.select("id", F.explode("geometries").alias("geometry"))).selectExpr("__piece.x1 - __piece.x0 as w", "__piece.y1 - __piece.y0 as h")
    assert all(max(r.w, r.h) < 0.0051 or (r.w and r.h) for r in pieces.collect())  # no long cells for thin shapes
