import datetime as dt
import json

from pyspark.sql import functions as F

from civicspark.functions import text
from civicspark.functions.geo import GEOMETRY
from civicspark.operators import gazetteer, items, merge, search, spatial, tagging

AS_OF = dt.datetime(2021, 8, 1)


def test_relevance_is_distance_and_age_less_a_bonus_in_two_blocks(spark):
    """Rows by what they show: hundreds of metres to the north of the point, age in days, and whether people can take part."""
    degree = 0.0009  # a hundred metres
    made = [  # id, hundreds of metres, days old (None: no date), open, hidden
        (1, 30, 20, False, False), (2, 1, 20, False, False), (3, 30, 20, True, False), (4, 2, 400, False, False), (5, 1, 400, True, False),
        (6, 0, None, False, False), (7, 0, 1, True, True), (8, 3, 365 * 6, False, False), (9, 90, 10, True, False),
    ]
    rows = [(i, "geo_item", 0, hidden, 13.4, 52.5 + d * degree, None, None if age is None else AS_OF - dt.timedelta(days=age), open_) for i, d, age, open_, hidden in made]
    schema = f"id long, kind string, kind_order int, hidden boolean, lng double, lat double, geometry {GEOMETRY}, newest_date timestamp, participation_open boolean"
    points = spark.createDataFrame([(1, 13.4, 52.5)], "query_id long, q_lng double, q_lat double")
    got = spatial.items_near(points, spark.createDataFrame(rows, schema), 10, F.lit(AS_OF)).orderBy("rank").collect()

    def want(row):
        _, d, age, open_, _ = row
        months = 3 if age is None else {20: 0, 400: 13, 10: 0}[age]
        return (age is None or age >= 42, 10 * d + months - 30 * open_)

    shown = sorted((r for r in made if not r[4] and r[0] not in (8, 9)), key=want)  # 8 is too old, 9 too far away
    assert [r.id for r in got] == [r[0] for r in shown]
    assert [r.is_old for r in got] == [want(r)[0] for r in shown]


def test_items_without_positions_are_not_ranked(spark):
    rows = [(1, 1, 13.4, 52.5, 0, k, 0.01, None, False, p) for k, p in ((1, [((13.4, 52.5), None)]), (2, []), (3, [((13.4, 52.6), None), ((13.4, 52.51), None)]))]
    position = f"array<struct<point:struct<lng:double,lat:double>,geometry:{GEOMETRY}>>"
    near = spark.createDataFrame(rows, f"query_id long, kind int, q_lng double, q_lat double, kind_order int, id long, dist_deg double, newest_date timestamp, participation_open boolean, positions {position}")
    assert [r.id for r in spatial.by_relevance(near, 10, F.lit(AS_OF)).orderBy("rank").collect()] == [1, 3]
    assert spatial.by_relevance(near.where("id = 2"), 10, F.lit(AS_OF)).collect() == []


def test_radius_of_points_and_shapes(spark):
    """An item 111 m to the north of two places, a line 1113 m to the north of a third, and an item far away."""
    line = ("LineString", [("line", 0, 0, [(13.40, 52.49), (13.50, 52.49)])])
    rows = [(1, 13.40, 52.481, None), (2, None, None, line), (3, 13.40, 52.60, None)]
    wide = spark.createDataFrame(rows, f"id long, lng double, lat double, geometry {GEOMETRY}")
    asked = [(1, 13.43, 52.48, 1200), (2, 13.43, 52.48, 1000), (3, 13.40, 52.48, 105), (4, 13.40, 52.48, 115)]
    places = spark.createDataFrame(asked, "sub long, q_lng double, q_lat double, radius_m int")
    assert {(r["sub"], r.id) for r in spatial.within_metres(places, wide).collect()} == {(1, 2), (4, 1)}


def tag(spark, cases, streets=(), numbers=(), places=()):
    """What each of the texts means: cases are (text, hints), read together as documents of one table."""
    docs = spark.createDataFrame([(i, t, hints) for i, (t, hints) in enumerate(cases)], "doc_id long, text string, hints array<string>")
    s = spark.createDataFrame([(i, n, d) for i, n, d in streets], "id long, name string, district string")
    n = spark.createDataFrame(list(numbers), "id long, geo_street_id long, number string")
    p = spark.createDataFrame(list(places), "id long, name string, district string, type string")
    found = [[] for _ in cases]
    for r in tagging.tag_text(docs, s, n, p).collect():
        found[r.doc_id].append((r.kind, r.target_id))
    return [sorted(x) for x in found]


NORTH, SOUTH = "Nord", "Süd"


def streets_only(*ids):
    return [("street", i) for i in ids]


def test_items_to_the_east_are_found_up_to_the_radius(spark):
    """A degree of longitude on the sphere is shorter than on the ellipsoid: items between 99.9 % of a radius and the radius, in all directions."""
    lats = (-85.0, -60.0, 0.0, 30.0, 52.5, 80.0)
    places = spark.createDataFrame([(i, 13.4, lat, r) for i, (lat, r) in enumerate((lat, r) for lat in lats for r in (500, 2000))], "sub_id long, q_lng double, q_lat double, radius_m int")
    step, m = F.radians(F.col("k") * 5.0), F.col("radius_m") * F.element_at(F.array(*[F.lit(v) for v in (0.9990, 0.9996, 0.99999)]), ((F.col("k") + 2) % 3 + 1).cast("int"))
    lat = F.col("q_lat") + F.cos(step) * m / 111_195.0
    items = places.crossJoin(spark.range(72).withColumnRenamed("id", "k")).select(
        (F.col("sub_id") * 72 + F.col("k")).alias("id"), (F.col("q_lng") + F.sin(step) * m / (111_195.0 * F.cos(F.radians((F.col("q_lat") + lat) / 2)))).alias("lng"), lat.alias("lat")
    )
    got = {(r.sub_id, r.id) for r in spatial.within_metres(places, items).collect()}
    brute = places.crossJoin(items).where(spatial.haversine_m(F.col("q_lng"), F.col("q_lat"), F.col("lng"), F.col("lat")) <= F.col("radius_m"))
    want = {(r.sub_id, r.id) for r in brute.collect()}
    assert got == want and len(want) > 10 * 72, (len(want), sorted(want - got)[:9])


def test_names_and_spellings_that_one_entry_has(spark):
    streets = [(1, "Ahornallee", NORTH), (2, "Birkenweg", SOUTH), (3, "Alter Birkenweg", NORTH)]
    streets += [(4, "Eichenstraße", NORTH), (5, "Alte Eichenstraße", NORTH), (6, "Ulmenstraße", SOUTH), (7, "Straße am Hof", SOUTH)]
    cases = (
        ("Am Montag wird die Ahornallee gesperrt.", [1]),
        ("Ahornallee, Birkenweg und nochmals Ahornallee", [1, 2]),
        ("der Alter Birkenweg endet hier", [3]),  # the longest of what overlaps
        ("Birkenweg (Alter Birkenweg)", [2, 3]),
        ("Ahornalleen und Birkenwegfest", []),  # a letter after the name
        ("im Klein-Birkenweg", []),  # a hyphen before it
        ("Ahornallee-Süd", [1]),
        ("", []),
        (None, []),
        ("Eichenstr. und Ulmenstrasse", [4, 6]),
        ("Strasse\tam  Hof", [7]),
        ("Alte\nEichenstrasse", [5]),
        ("Eichen-, Ulmen- und Lindenstraße", [4, 6]),
    )
    assert tag(spark, [(t, None) for t, _ in cases], streets) == [streets_only(*ids) for _, ids in cases]


def test_one_name_in_two_districts(spark):
    streets = [(1, "Marktgasse", NORTH), (2, "Marktgasse", SOUTH), (3, "Torgasse", SOUTH), (4, "Torgasse", SOUTH), (5, "Fährweg", SOUTH)]
    cases = (
        ("in der Marktgasse", None, []),  # nothing tells which
        ("in der Marktgasse", [SOUTH], streets_only(2)),
        ("in der Marktgasse", [NORTH, SOUTH], []),
        ("in der Torgasse", [SOUTH], []),  # two in one district
        ("Marktgasse am Anger", None, [("place", 9), ("street", 1)]),  # a certain place decides
        ("Marktgasse, Fährweg", None, streets_only(2, 5)),  # a certain street does
        ("Marktgasse, Fährweg 4", None, [("street", 2), ("street_number", 50)]),  # so does a number
    )
    got = tag(spark, [c[:2] for c in cases], streets, [(50, 5, "4")], [(9, "Anger", NORTH, "Park")])
    assert got == [c[2] for c in cases]


def test_house_numbers_in_texts(spark):
    streets = [(1, "Weidenufer", NORTH), (2, "Weidenufer", SOUTH), (3, "Kiesweg", NORTH)]
    numbers = [(11, 1, "8"), (12, 2, "9"), (13, 1, "10B"), (14, 1, "12"), (15, 2, "12"), (16, 3, "5"), (17, 3, "31")]
    cases = (
        ("Weidenufer 8", None, [("street_number", 11)]),  # only one of the streets has it
        ("Weidenufer 9 bis 10", None, [("street_number", 12)]),  # 9B is unknown, 9 is not
        ("Weidenufer 10 b,", None, [("street_number", 13)]),
        ("Weidenufer 10", None, streets_only(1, 2)),  # no such number: all streets of the name
        ("Weidenufer 12", None, []),
        ("Weidenufer 12", [SOUTH], [("street_number", 15)]),
        ("Kiesweg 5/7", None, [("street_number", 16)]),
        ("Kiesweg 31–33", None, [("street_number", 17)]),
        ("Kiesweg, 31", None, streets_only(3)),  # a number stands right behind its street
        ("Kiesweg Nr. 31", None, streets_only(3)),
        ("Kiesweg 5 und Kiesweg", None, [("street", 3), ("street_number", 16)]),
    )
    assert tag(spark, [c[:2] for c in cases], streets, numbers) == [c[2] for c in cases]


def test_places_and_what_gives_way(spark):
    places = [(1, "Heidegarten", NORTH, "Park"), (2, "Moorland", NORTH, "LOR"), (3, "Moorland", SOUTH, "LOR"), (4, "Wallgraben", SOUTH, "LOR"), (5, "Wallgraben", SOUTH, "School"), (6, "Mühlenkiez", NORTH, "LOR")]
    streets = [(7, "Heidegarten", SOUTH), (8, "Uferpfad", NORTH)]
    cases = (
        ("im Heidegarten", None, [("place", 1)]),  # a street gives way to the place of its name
        ("Heidegarten 2", None, [("street_number", 70)]),  # and that to a house number
        ("bei Moorland", None, []),
        ("bei Moorland", [SOUTH], [("place", 3)]),
        ("Wallgraben", [SOUTH], [("place", 5)]),  # a school before a planning area
        ("das Mühlenviertel", None, [("place", 6)]),
        ("Mühlenkiez am Uferpfad", None, [("street", 8)]),  # a planning area gives way to a street of its district
        ("Heidegarten am Uferpfad", None, [("place", 1), ("street", 8)]),
    )
    assert tag(spark, [c[:2] for c in cases], streets, [(70, 7, "2")], places) == [c[2] for c in cases]


def test_a_failing_text_fails_alone(spark, monkeypatch):
    class Odd(tagging.Dictionary):
        def hits(self, text):
            if "boom" in text:
                raise ValueError(text)
            return super().hits(text)

    monkeypatch.setattr(tagging, "Dictionary", Odd)
    docs = spark.createDataFrame([(1, "Kiesweg"), (2, "boom Kiesweg"), (3, None), (4, "kein Kiesweg")], "doc_id long, text string")
    got = {r.doc_id: r for r in tagging.text_hits(docs, spark.createDataFrame([("Kiesweg",)], "name string")).collect()}
    assert got.keys() == {1, 2, 4} and (got[4].start, got[4].error) == (6, None) and got[2].name is None and "boom" in got[2].error


def test_gazetteer_in_slices(spark):
    docs = spark.createDataFrame([(1, "ab abc bcd"), (2, "bcd"), (3, None)], "doc_id long, text string")
    names = spark.createDataFrame([(x, 1 + (x == "bcd")) for x in ("ab", "abc", "bcd", "abc bcd")], "name string, mask int")
    whole = sorted(map(tuple, tagging.text_hits(docs, names).collect()))
    assert sorted(map(tuple, tagging.text_hits(docs, names, max_terms=2).collect())) == whole


def test_streets(spark):
    rows = [("1", "Weg", "10", "1", "B", "Mitte", 13.0, 52.0, 0), ("2", "Weg", "2 a", "1", "B", "Mitte", 13.1, 52.1, 1), ("3", "Weg", "x", "1", "B", "Wedding", 13.2, 52.2, 2), ("4", "Weg", "1", "1", "B", "Nowhere", 0.0, 0.0, 3), ("5", "Weg", " ", "1", "B", "Mitte", 0.0, 0.0, 4)]
    numbers = gazetteer.number_rows(spark.createDataFrame(rows, "external_id string, name string, number string, zip string, city string, local_center string, lng double, lat double, seq int"))
    r = gazetteer.assemble_streets(numbers).first()
    assert (r.district, r.numbers, r.street_number_count, r.lng) == ("Mitte", ["2A", "10", "X"], 3, 13.0)
    assert r.geometry.type == "LineString"


def test_street_search(spark):
    names = spark.createDataFrame([("Große Straße", "A", 5), ("Georgenstraße", "A", 9), ("Richard 100%", "B", 1), ("Richter", "B", 3)], "name string, district string, street_number_count long")
    asked = spark.createDataFrame([("Ri",), ("orge",), ("strasse",), ("%",), ("gro str",)], "search string")
    got = [(r.search, r.name) for r in search.search_prefix(asked.where("length(search) < 3"), names).orderBy("search", "rank").collect()]
    assert got == [("Ri", "Richter"), ("Ri", "Richard 100%")]
    got = [(r.search, r.name) for r in search.search_contains(asked, names).orderBy("search", "rank").collect()]
    assert got == [("gro str", "Große Straße"), ("orge", "Georgenstraße"), ("strasse", "Große Straße")]


def test_partial_upsert(spark):
    old = spark.createDataFrame([(1, 1, "a", "Old", "x", dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1)), (2, 1, "b", "Same", "y", dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1))], "id long, source_id long, external_id string, title string, url string, inserted_at timestamp, updated_at timestamp")
    batch = spark.createDataFrame([(1, "a", "New", None, 1, ["title"]), (1, "a", "Newer", None, 2, ["title", "url"]), (1, "b", "Same", None, 1, ["title"]), (1, "c", "Third", "z", 1, ["title", "url"])], "source_id long, external_id string, title string, url string, seq int, present array<string>")
    now = F.lit(AS_OF)
    got = {r.external_id: r for r in merge.merge_snapshot(old, batch, ["source_id", "external_id"], now).collect()}
    assert (got["a"].id, got["a"].title, got["a"].url, got["a"].updated_at) == (1, "Newer", None, AS_OF)
    assert (got["b"].url, got["b"].updated_at) == ("y", dt.datetime(2020, 1, 1)) and got["a"].inserted_at == dt.datetime(2020, 1, 1)
    assert got["c"].inserted_at == AS_OF and got["c"].id is not None
    full = {r.external_id: r for r in merge.merge_snapshot(old, batch.drop("present"), ["source_id", "external_id"], now, replace=True).collect()}
    assert full["b"].url is None


SUBS = "sub_id long, user_id long, radius_m int, lng double, lat double"
EVENTS = "seq int, op string, user_id long, lng double, lat double, radius_m int"


def after(spark, subs, events):
    got = merge.apply_subscription_events(spark.createDataFrame(subs, SUBS), spark.createDataFrame(events, EVENTS)).collect()
    return sorted((r.user_id, r.radius_m, r.lng) for r in got)


def test_subscription_events(spark):
    subs = [(1, 10, 500, 13.0, 52.0), (2, 10, 500, 13.5, 52.0), (3, 11, 500, 13.0, 52.0), (4, 13, 700, 13.0, 52.0)]
    events = [(1, "unsubscribe", 10, 13.0002, 52.0, None), (2, "update", 11, 13.0, 52.0, 900), (3, "subscribe", 12, 13.0, 52.0, None), (4, "subscribe", None, 13.0, 52.0, 1), (5, "update", 14, 13.0, 52.0, 5)]
    assert after(spark, subs, events) == [(10, 500, 13.5), (11, 900, 13.0), (12, 2000, 13.0), (13, 700, 13.0)]
    assert after(spark, subs, []) == [(10, 500, 13.0), (10, 500, 13.5), (11, 500, 13.0), (13, 700, 13.0)] and after(spark, [], []) == []


def test_subscription_events_see_those_before_them(spark):
    """Points 48 metres apart are one place, 700 metres apart are not."""
    here, near, far = 13.0, 13.0007, 13.01
    new = (1, "subscribe", 7, here, 52.0, None)
    assert after(spark, [], [new, (2, "unsubscribe", 7, near, 52.0, None)]) == []
    assert after(spark, [], [new, (2, "update", 7, near, 52.0, 900)]) == [(7, 900, here)]
    assert after(spark, [], [new, (2, "update", 7, far, 52.0, 900)]) == [(7, 2000, here)]
    assert after(spark, [], [(2, "unsubscribe", 7, near, 52.0, None), (1, "subscribe", 7, here, 52.0, 300), (3, "subscribe", 7, near, 52.0, 400)]) == [(7, 400, near)]
    assert after(spark, [(1, 7, 500, here, 52.0)], [(1, "subscribe", 7, near, 52.0, 800), (2, "subscribe", 7, far, 52.0, None)]) == [(7, 800, here), (7, 2000, far)]
    assert after(spark, [(1, 7, 500, here, 52.0), (2, 7, 600, near, 52.0)], [(1, "unsubscribe", 7, here, 52.0, None)]) == [(7, 600, near)]


def test_news_upsert_replaces_mentions(spark):
    day = dt.datetime(2020, 1, 1)
    old = spark.createDataFrame([(1, 1, "a", "A", day, day), (2, 1, "b", "B", day, day)], "id long, source_id long, external_id string, title string, inserted_at timestamp, updated_at timestamp")
    batch = spark.createDataFrame([(1, "a", "A", 1), (1, "c", "C", 1)], "source_id long, external_id string, title string, seq int")
    before = spark.createDataFrame([(1, "street", 5), (1, "place", 6), (2, "street", 7)], "news_item_id long, kind string, target_id long")
    said = spark.createDataFrame([(1, "a", "street", 8), (1, "a", "street", 8), (1, "c", "place", 9)], "source_id long, external_id string, kind string, target_id long")
    items_, mentions = merge.upsert_news(old, batch, before, said, F.lit(AS_OF))
    ids = {r.external_id: r.id for r in items_.collect()}
    assert (ids["a"], ids["b"]) == (1, 2) and {r.external_id for r in items_.where(F.col("updated_at") == F.lit(AS_OF)).collect()} == {"c"}
    assert sorted(map(tuple, mentions.collect())) == sorted([(1, "street", 8), (2, "street", 7), (ids["c"], "place", 9)])


def test_distance_of_news_is_that_of_their_nearest_part(spark):
    line = ("LineString", [("line", 0, 0, [(13.2, 52.53), (13.3, 52.53)])])
    rows = [(1, False, [(13.25, 52.54), (13.25, 52.51)], None), (2, False, None, [line]), (3, False, None, None), (4, True, [(13.25, 52.5)], None), (5, False, [(13.25, 52.551)], [line])]
    news = spark.createDataFrame(rows, f"id long, hidden boolean, geo_points array<struct<lng:double,lat:double>>, geometries array<{GEOMETRY}>")
    points = spark.createDataFrame([(1, 13.25, 52.5)], "query_id long, q_lng double, q_lat double")
    got = {r.id: round(r.dist_deg, 6) for r in spatial.nearest_news(points, news, 10).collect()}
    assert got == {1: 0.01, 2: 0.03, 5: 0.03}
    assert [r.id for r in spatial.nearest_news(points, news, 1).collect()] == [1]


def test_map_documents(spark):
    schema = "kind string, id long, title string, lng double, lat double, source_id long, participation_open boolean"
    rows = [("geo_item", 1, 'Say "hi"', 13.5, 52.5, 1, True), ("geo_item", 2, None, None, None, 9, None)]
    sources = spark.createDataFrame([(1, "S", "#fff")], "source_id long, short_name string, color string")
    got = {r.id: json.loads(r.document) for r in items.map_documents(spark.createDataFrame(rows, schema), sources, F.col("id")).collect()}
    assert got[1] == {"type": "geo_item", "id": 1, "title": 'Say "hi"', "participation_open": True, "source": "S", "color": "#fff", "positions": [{"type": "geo_item", "id": 1, "point": {"lat": 52.5, "lng": 13.5}}]}
    assert got[2] == {"type": "geo_item", "id": 2, "title": None, "participation_open": None, "source": None, "color": None, "positions": [{"type": "geo_item", "id": 2}]}


def test_search_by_stems(spark):
    names = spark.createDataFrame([("Straße der Gärtnerinnen", "A", 5), ("Am Gartenweg", "A", 9), ("Kirchenplatz", "B", 1)], "name string, district string, street_number_count long")
    asked = spark.createDataFrame([("gärtnerin",), ("kirche",), ("die gärten",)], "search string")
    got = [(r.search, r.name) for r in search.search_contains(asked, names, tokens=text.german_tokens).orderBy("search", "rank").collect()]
    gardener = "Straße der Gärtnerinnen"
    assert got == [("die gärten", "Am Gartenweg"), ("die gärten", gardener), ("gärtnerin", gardener), ("kirche", "Kirchenplatz")]


def test_news_positions_and_caches(spark):
    mentions = spark.createDataFrame([(1, "place", 5), (1, "street", 7), (1, "street_number", 6), (2, "street", 8)], "news_item_id long, kind string, target_id long")
    places = spark.createDataFrame([("place", 5, (13.0, 52.0), None), ("street", 7, None, ("LineString", [("line", 0, 0, [(1.0, 2.0), (3.0, 4.0)])])), ("street_number", 6, (13.1, 52.1), None), ("street", 8, None, None)], f"kind string, target_id long, point struct<lng:double,lat:double>, geometry {GEOMETRY}")
    r = items.positions_of_news(mentions, places).collect()
    assert [(p.type, p.id) for p in r[0].positions] == [("street", 7), ("street_number", 6), ("place", 5)] and len(r) == 1
    c = items.cached_geometries(mentions, places).first()
    assert len(c.geometries) == 1 and [p.lng for p in c.geo_points] == [13.1, 13.0]
    d = {(x.kind, x.target_id): x.shown_kind for x in items.collapse_single_news(mentions).collect()}
    assert set(d.values()) == {"news_item"}


def test_geometries_are_kept_up_by_what_changed(spark):
    """Against the bulk refresh; items that nothing touches are not made anew."""
    line = ("LineString", [("line", 0, 0, [(13.0, 52.0), (13.1, 52.0)])])
    places = [("street", k, (13.0 + k, 52.0) if k % 2 else None, line if k % 3 else None) for k in range(8)] + [("place", 3, None, None)]
    said = [(n, "street", (n * 3 + j) % 8) for n in range(20) for j in range(2)] + [(30, "place", 3)]
    frames = lambda m, g: (spark.createDataFrame(m, "news_item_id long, kind string, target_id long"), spark.createDataFrame(g, f"kind string, target_id long, point struct<lng:double,lat:double>, geometry {GEOMETRY}"))
    cached = items.cached_geometries(*frames(said, places))
    ids = lambda rows: spark.createDataFrame([(r,) for r in rows], "news_item_id long")
    key = spark.createDataFrame([("street", 5)], "kind string, target_id long")
    moved = [p if p[1] != 5 else ("street", 5, None, None) for p in places]
    more = [m for m in said if m[0] not in (1, 2)] + [(1, "street", 7), (40, "street", 1), (30, "street", 1)]
    for m, g, news, rows, touched in (
        (said, moved, None, key, {n for n, _, t in said if t == 5}),
        (more, places, ids([1, 2, 30, 40]), None, {1, 2, 30, 40}),
        (more, moved, ids([1, 2, 30, 40]), key, {1, 2, 30, 40} | {n for n, k, t in more if (k, t) == ("street", 5)}),
        (said, places, None, None, set()),
    ):
        changes, after = items.refresh_geometries(cached, *frames(m, g), news, rows)
        assert {r.news_item_id for r in changes.collect()} == touched
        assert sorted(map(tuple, after.collect()), key=str) == sorted(map(tuple, items.cached_geometries(*frames(m, g)).collect()), key=str)
