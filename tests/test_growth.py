"""What queries hold and move as their tables grow."""

import json

from pyspark.sql import functions as F

from civicspark import storage
from civicspark.functions.geo import GEOMETRY, as_box, box_distance, distance
from civicspark.operators import items, spatial, tagging
from civicspark.plans import feed_queries
from civicspark.sources import feeds, gazette


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _crowd(spark, n):
    """n items on a spot of 40 metres, and a few around it."""
    crowd = spark.range(n).select("id", (F.lit(13.4) + F.col("id") % 211 * 2e-6).alias("lng"), (F.lit(52.5) + F.col("id") % 199 * 2e-6).alias("lat"))
    around = spark.range(60).select((F.col("id") + n).alias("id"), (F.lit(13.4) + F.col("id") * 0.0011).alias("lng"), (F.lit(52.5) - F.col("id") * 0.0007).alias("lat"))
    return crowd.unionByName(around).withColumns({"kind": F.lit("geo_item"), "hidden": F.lit(False)})


def _points(spark):
    return spark.range(40).select(F.col("id").alias("query_id"), (F.lit(13.37) + F.col("id") * 0.0013).alias("q_lng"), (F.lit(52.5003) + F.lit(0.0001) * (F.col("id") % 5)).alias("q_lat"))


def test_pairs_of_nearest_grow_with_k_and_not_with_the_crowd(spark):
    points, k = _points(spark).where("q_lng > 13.3995 and q_lng < 13.4005").unionByName(spark.createDataFrame([(99, 13.4002, 52.5002)], "query_id long, q_lng double, q_lat double")), 10
    pairs = [spatial._pairs_for_nearest(points, _crowd(spark, n), k, 0.05).count() for n in (3_000, 30_000)]
    assert max(pairs) < 300 * k * points.count(), pairs  # 30,000 a point if the whole spot is met; cells are halved twice at once


def test_nearest_are_those_of_brute_force_beside_a_crowd(spark):
    points, items = _points(spark), _crowd(spark, 20_000)
    got = {(r.query_id, r.near_rank, r.id) for r in spatial.nearest(points, items, 7).collect()}
    d = F.sqrt((F.col("lng") - F.col("q_lng")) ** 2 + (F.col("lat") - F.col("q_lat")) ** 2)
    want = points.crossJoin(items).withColumn("d", d).where("d <= 0.05").selectExpr("query_id", "id", "row_number() over (partition by query_id order by d, id) as r").where("r <= 7")
    assert got == {(r.query_id, r.r, r.id) for r in want.collect()}


def test_rows_that_are_spread_over_cells_are_not_broadcast(spark):
    """Spark plans with the size before rows are spread, which a driver could not hold after."""
    points, items = _points(spark), _crowd(spark, 300)
    reach = F.lit(0.01)
    for df in (spatial._pairs_for_nearest(points, items, 5, 0.05), spatial.reach_join(points, items, reach, reach)):
        for below in _plan(df).split("BroadcastExchange")[1:]:
            assert "Generate" not in below


def _alert_tables(spark):
    subs = spark.range(300).select(F.col("id").alias("sub_id"), (F.col("id") % 250).alias("user_id"), F.lit(900).alias("radius_m"), (F.lit(13.3) + F.col("id") % 17 * 0.01).alias("lng"), (F.lit(52.5) + F.col("id") % 13 * 0.005).alias("lat"))
    items = spark.range(400).select(
        (F.col("id") % 390).alias("id"), F.lit("geo_item").alias("kind"), F.lit(0).alias("kind_order"), F.timestamp_seconds(1_000_000 + F.col("id") % 390 % 7).cast("timestamp_ntz").alias("inserted_at"),
        (F.lit(13.3) + F.col("id") % 19 * 0.01).alias("lng"), (F.lit(52.5) + F.col("id") % 11 * 0.005).alias("lat"),
    )
    return subs, items


def test_alerts_of_one_subscription_are_not_dealt_anew(spark):
    """Pairs that can come only once go on from where they are found: rows that are dealt after the join are those of the others."""
    subs, items = _alert_tables(spark)
    found = spatial.alerts(subs, items, F.lit("1970-01-01").cast("timestamp_ntz"))
    brute = subs.crossJoin(items.withColumnsRenamed({"lng": "x", "lat": "y"})).where(spatial.haversine_m(F.col("lng"), F.col("lat"), F.col("x"), F.col("y")) <= 900).select("user_id", "id").distinct()
    rows = [(r.user_id, r.id) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(r.user_id, r.id) for r in brute.collect()}
    top = spatial.alerts(subs, items, F.lit("1970-01-01").cast("timestamp_ntz"))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert top[0].startswith("Union"), top[0]  # no aggregate above the union


def test_ends_of_digests_are_those_of_the_digests(spark):
    subs, items = _alert_tables(spark)
    since = F.lit("1970-01-01").cast("timestamp_ntz")
    whole = spatial.digest(spatial.alerts(subs, items, since)).select("user_id", F.size("items").alias("n"), F.get("items", F.lit(0)).alias("a"), F.element_at("items", -1).alias("b"))
    ends = spatial.digest_ends(subs, items, since)
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in ends.collect()}
    assert "collect_list" not in _plan(ends)


def test_shapes_that_are_their_boxes_are_measured_as_boxes(spark):
    """Rectangles and lines along an axis; a triangle, a slanted line and a ring with a hole are looked at in full."""
    ring = lambda *p: [{"kind": "polygon", "part": 0, "ring": 0, "coords": list(p)}]
    path = lambda *p: [{"kind": "line", "part": 0, "ring": 0, "coords": list(p)}]
    hole = [*ring((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)), {"kind": "polygon", "part": 0, "ring": 1, "coords": [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]}]
    shapes = {
        1: ring((0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0), (0.0, 0.0)), 2: ring((0.0, 0.0), (0.0, 2.0), (4.0, 2.0), (4.0, 0.0), (0.0, 0.0)), 3: path((0.0, 1.0), (5.0, 1.0), (3.0, 1.0)),
        4: ring((0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)), 5: path((0.0, 0.0), (3.0, 3.0)), 6: hole, 7: ring((0.0, 0.0), (4.0, 2.0), (4.0, 0.0), (0.0, 2.0), (0.0, 0.0)),
    }
    df = spark.createDataFrame([(i, ("Shape", p)) for i, p in shapes.items()] + [(8, None)], f"id long, g {GEOMETRY}").withColumn("box", as_box(F.col("g")))
    assert {r.id for r in df.where("box is not null").collect()} == {1, 2, 3}
    at = spark.range(64).select((F.col("id") % 8 - 1.5).alias("x"), (F.floor(F.col("id") / 8) - 1.5).alias("y"))
    both = df.where("box is not null").crossJoin(at).select(box_distance(F.col("box"), F.col("x"), F.col("y")).alias("a"), distance(F.col("g"), F.col("x"), F.col("y")).alias("b")).collect()
    assert all(abs(r.a - r.b) < 1e-12 for r in both)


def test_news_meet_the_points_that_they_can_be_nearest_to(spark):
    """In a crowd a point is met by few of the parts within the degrees."""
    at = F.struct(F.col("lng"), F.col("lat"))
    news = _crowd(spark, 4_000).select("id", "hidden", F.array(at).alias("geo_points"), F.lit(None).cast(f"array<{GEOMETRY}>").alias("geometries"))
    points = spark.createDataFrame([(1, 13.4002, 52.5002)], "query_id long, q_lng double, q_lat double")
    met, real = [], spatial.reach_join

    def watched(*a):
        met.append(real(*a))
        return met[-1]

    spatial.reach_join = watched
    try:
        got = [r.id for r in spatial.nearest_news(points, news, 5).orderBy("near_rank").collect()]
    finally:
        spatial.reach_join = real
    d = F.sqrt((F.col("lng") - 13.4002) ** 2 + (F.col("lat") - 52.5002) ** 2)
    assert got == [r.id for r in _crowd(spark, 4_000).orderBy(d, "id").limit(5).collect()]
    assert met[0].count() < 1_000


def test_landed_pages_are_files_of_one_folder(spark):
    rows = spark.range(50).withColumns({"page": F.floor(F.col("id") / 7), "s": F.col("id").cast("string")})
    folder = feed_queries._land(rows, F.col("page"), F.col("s"), ("[", "]"), "pages", feed_queries.LAYOUTS)
    files = spark.read.text(folder, wholetext=True)
    assert not any("=" in path.removeprefix(f"file:{folder}") for path in files.inputFiles()) and len(files.inputFiles()) == 8
    assert sorted(sorted(json.loads(r.value)) for r in files.collect()) == sorted([list(range(k, min(k + 7, 50))) for k in range(0, 50, 7)])


def test_a_kml_text_is_parsed_once_for_each_kind_of_shape(spark, tmp_path):
    kml = "<kml><Placemark><Point><coordinates>1,2</coordinates></Point></Placemark><Placemark><LineString><coordinates>1,2 3,4</coordinates></LineString></Placemark></kml>"
    (tmp_path / "1.json").write_text(json.dumps({"results": [{"id": "7", "kml": kml}, {"id": "8", "kml": "<kml"}]}))
    out = feeds.bike_projects(spark, str(tmp_path)).select("external_id", "geo_point", "geometry", F.col("geometry.type").alias("shape"))
    got = out.orderBy("external_id").collect()
    assert got[0].geo_point.lat == 2.0 and got[0].shape == "LineString" and len(got[0].geometry.parts[0].coords) == 2 and got[1].geometry is None
    assert out._jdf.queryExecution().optimizedPlan().toString().count("xpath") <= 3


def test_an_outline_entry_is_parsed_once_for_each_column(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<x><outline level='1' title='A &amp; B'><pageno>3</pageno></outline><outline level='' title='C'/></x>")
    out = gazette.outline_from_xml(spark, str(tmp_path)).select("pos", "level", "page", "title")
    assert [tuple(r) for r in out.orderBy("pos").collect()] == [(0, "1", "3", "A & B"), (1, None, None, "C")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("xpath") <= 3


def test_objects_kept_as_texts_are_not_sought_in_their_file(spark, tmp_path):
    one = {"url": "/p/1/", "title": "A", "status": 0, "participation": 0, "point": {"type": "Feature", "geometry": {"type": "Point", "coordinates": [13.1, 52.2]}}}
    (tmp_path / "1.json").write_text(json.dumps([one, {**one, "url": "/p/2/", "point": ""}], indent=1))
    (tmp_path / "2.json").write_text("[]\n")
    out = feeds.participation(spark, str(tmp_path))
    assert [(r.external_id, r.geo_point and r.geo_point.lat, r.participation_open) for r in out.orderBy("external_id").collect()] == [("/p/1/", 52.2, True), ("/p/2/", None, True)]
    assert "FileScan json" not in _plan(out)


def _tagged(spark, n_docs=40):
    streets = spark.createDataFrame([(1, "Ahornweg", "Mitte"), (2, "Ahornweg", "Pankow"), (3, "Birkenweg", "Mitte")], "id long, name string, district string")
    numbers = spark.createDataFrame([(10, 1, "3"), (11, 2, "3"), (12, 3, "4")], "id long, geo_street_id long, number string")
    places = spark.createDataFrame([(20, "Nordpark", "Mitte", "Park"), (21, "Nordpark", "Pankow", "LOR"), (22, "Ahornweg", "Mitte", "School")], "id long, name string, district string, type string")
    text = F.concat(F.repeat(F.lit("Ahornweg 3, Ahornweg 3a, Nordpark. "), (F.col("id") % 4).cast("int")), F.when(F.col("id") % 3 == 0, "Birkenweg 4").otherwise("Birkenweg"))
    docs = spark.range(n_docs).select(F.col("id").alias("doc_id"), text.alias("text"), F.array(F.when(F.col("id") % 2 == 0, "Pankow").otherwise("Spandau")).alias("hints"))
    return tagging.tag_text(docs, streets, numbers, places)


def test_mentions_move_what_texts_mean_once(spark):
    plan = _plan(_tagged(spark))
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning(doc_id") == 1 and "Window" not in plan, plan


def test_mentions_do_not_depend_on_where_batches_end(spark):
    want = sorted(map(tuple, _tagged(spark).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sorted(map(tuple, _tagged(spark).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len({r[0] for r in got}) == 40 and {r[1] for r in got} == {"street", "street_number", "place"}, got


def test_tasks_get_a_bounded_number_of_mentions(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 100)
    gazetteer = spark.createDataFrame([("street", k, (13.0, 52.0), None) for k in range(5)], f"kind string, target_id long, point struct<lng:double,lat:double>, geometry {GEOMETRY}")
    for n in (200, 2_000):
        mentions = spark.range(n).select((F.col("id") / 2).cast("long").alias("news_item_id"), F.lit("street").alias("kind"), (F.col("id") % 5).alias("target_id"))
        out = items.cached_geometries(mentions, gazetteer)
        assert "hashpartitioning(news_item_id#" in _plan(out) and f", {max(4, n // 100)}), REPARTITION_BY_NUM" in _plan(out), _plan(out)
        assert out.count() == n // 2 and out.selectExpr("sum(size(geo_points))").first()[0] == n


def test_places_of_large_ids_are_told_apart(spark):
    big = 1 << 60
    places = spark.createDataFrame([(big + 1, "Nordpark", "Mitte", "Park"), (big, "Nordpark", "Mitte", "Park")], "id long, name string, district string, type string")
    streets, numbers = spark.createDataFrame([], "id long, name string, district string"), spark.createDataFrame([], "id long, geo_street_id long, number string")
    docs = spark.createDataFrame([(1, "Nordpark", ["Mitte"])], "doc_id long, text string, hints array<string>")
    assert [(r.target_id, r.resolution) for r in tagging.tag_text(docs, streets, numbers, places).collect()] == [(big, "district")]
