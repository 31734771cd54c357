import datetime as dt

import pytest
from pyspark.sql import functions as F

from civicspark.functions import dates, geo, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int"
    row = tuple(values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize("lines,want", [
    ("Bau-\nstelle", "Baustelle"), ("S-\nBahn", "S-Bahn"), ("Nord-\nSüd", "Nord-Süd"), ("a-\nbc", "a-bc"), ("one \n two", "one\ntwo"), ("Größen-\n\nänderung", "Größenänderung"),
])
def test_dehyphen(spark, lines, want):
    assert one(spark, text.dehyphen(F.col("c")), c=lines) == want


@pytest.mark.parametrize("raw,want", [
    ("Ulmenstrasse bis Ahorn Str. oder str.", "Ulmenstraße bis Ahorn Straße oder straße"), ("Ulmen-, Ahorn- und Eichenstraße", "Ulmenstraße, Ahornstraße und Eichenstraße"), ("q\t \nr", "q r"),
])
def test_street_normalize(spark, raw, want):
    assert one(spark, text.street_normalize(F.col("c")), c=raw) == want


@pytest.mark.parametrize("raw,want", [("8 gehört", "8G"), ("41 f; g", "41F"), ("5-9", "5"), ("6\n7", "6"), ("Nr. 3", None), ("", None)])
def test_house_number(spark, raw, want):
    assert one(spark, text.house_number(F.col("c")), c=raw) == want


def test_levenshtein_of_part_and_of_other(spark):
    cost = lambda a, b: one(spark, text.weighted_levenshtein(F.col("a"), F.col("b")), a=a, b=b)
    assert cost("orge", "georgenstraße") == 9
    assert cost("abc", "axc") == 11
    assert cost("", "ab") == 2 and cost("ab", "") == 20


def test_format_query(spark):
    assert one(spark, text.format_query(F.col("c")), c="Große  Straße!") == "Große:* & Straße:*"


def test_forum_description(spark):
    raw = "Kein DAF-Beitrag vorhanden.<br>Neubau &amp; mehr DAF-Post: http://x<BR/>"
    assert one(spark, text.forum_description(F.col("c")), c=raw) == "Neubau & mehr"
    assert one(spark, text.forum_description(F.col("c")), c="nv") == ""


def test_quarters(spark):
    start, end = (one(spark, f(F.col("c")), c="2. Quartal 2022") for f in (dates.quarter_start, dates.quarter_end))
    assert (start, end) == (dt.datetime(2022, 3, 31, 22), dt.datetime(2022, 6, 29, 22))
    assert one(spark, dates.quarter_start(F.col("c")), c="5. Quartal 2022") is None


def test_timestamps(spark):
    at = lambda c: one(spark, dates.parse_timestamp(F.col("c")), c=c)
    assert at("Fri, 16 Jul 2021 10:20:00 +0200") == dt.datetime(2021, 7, 16, 8, 20)
    assert at("2021-07-16T10:20:00+0200") == at("2021-07-16T10:20:00+02:00") == dt.datetime(2021, 7, 16, 8, 20)
    assert at("2021-07-16 10:20:00.5+02:00").second == 0 and at("nonsense") is None


def test_issue_date(spark):
    assert one(spark, dates.german_issue_date(F.col("c")), c="x\nAusgegeben zu Berlin am 5. März 2021\ny") == dt.date(2021, 3, 5)


def test_newest_date_is_the_closest(spark):
    d = lambda s: F.lit(s).cast("timestamp")
    got = dates.newest_date(d("2021-08-01"), d("2021-07-01"), d("2021-08-03"), d(None))
    assert one(spark, got) == dt.datetime(2021, 8, 3)
    assert one(spark, dates.newest_date(d("2021-08-01"), d(None), d(None), d(None))) is None


def test_geometries(spark):
    square = '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[2,1],[2,2],[1,2],[1,1]]]}'
    g = geo.geojson_geometry(F.col("g"))
    far = lambda x, y: one(spark, geo.distance(g, F.lit(x), F.lit(y)), g=square)
    assert far(3.0, 3.0) == 0 and far(1.5, 1.5) == 0.5 and far(5.0, 4.0) == 1
    assert tuple(one(spark, geo.center(g), g=square)) == (2.0, 2.0)
    m = one(spark, geo.haversine_m(F.lit(13.0), F.lit(52.0), F.lit(13.0), F.lit(53.0)))
    assert abs(m - 111_195) < 5
    line = '{"type":"LineString","coordinates":[[13.0,52.0],[13.0,53.0]]}'
    assert abs(one(spark, geo.distance_m(g, F.lit(13.01), F.lit(52.5)), g=line) - 679.3) < 1


def test_page_and_section(spark):
    page = "Header\nHeader\n\nFirst line\nSecond\nABl. Nr. 30 / 16. 7. 2021"
    assert one(spark, text.page_body(F.col("c")), c=page) == "First line\nSecond"
    assert one(spark, text.section_title(F.col("c")), c="A long\ntitle\n\nBody ends.\nMore") == "A long title"
    assert one(spark, text.section_description(F.col("c")), c="A long\ntitle\n\nBody ends.\nMore") == "Body ends"
    assert one(spark, text.section_title(F.col("c")), c="Only one\nmore") == "Only one"


def test_main_text(spark):
    html = "<nav>no</nav><div class='x article'><p>Some<br>text &amp; <a href='/d'>more</a></p><script>no</script></div><p>no</p>"
    pages = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    got = {r.id: r for r in text.main_text(pages, tag="*", cls="article").collect()}
    assert got[1].main_text == "Sometext & more" and got[1].links == ["/d"] and got[2].main_text is None


def test_stems_and_stop_words(spark):
    """Words of the published sample vocabulary of the stemmer, without accents."""
    want = {"aufeinander": "aufeinand", "kategorie": "kategori", "kategorischen": "kategor", "katzen": "katz", "haus": "haus", "hauser": "haus", "freundlichkeit": "freundlich", "ergebnisse": "ergebnis", "aufgabe": "aufgab", "neuen": "neu", "bauer": "bau", "y": "y"}
    assert {w: text._stem(w) for w in want} == want
    rows = spark.createDataFrame([("Die Straße der Gärtnerinnen",), ("",), (None,)], "t string")
    assert [r.s for r in rows.select(text.german_tokens(F.col("t")).alias("s")).collect()] == [["strass", "gartnerinn"], [], None]


def test_numbers_that_texts_begin_with(spark):
    rows = spark.createDataFrame([("1.5",), ("-2x",), ("3e2",), ("x",), ("",), (None,), (".5",)], "t string")
    assert [r.n for r in rows.select(text.float_or(F.col("t"), 9).alias("n")).collect()] == [1.5, -2.0, 300.0, 9.0, 9.0, 9.0, 9.0]


def test_elements_by_class_and_role_and_links_by_class(spark):
    page = "<div class='article'>no</div><div class='big article' role='main'>yes <b>and</b><br> more<script>x</script></div><a href='/0'>0</a><p class='dl'><i><a href='/1?a&amp;b'>1</a></i></p><a class='dl' href='/2'>2</a><a href='/3'>3</a>"
    pages = spark.createDataFrame([(page,), (None,), ("<p>nothing",)], "html string")
    got = text.main_text(pages, tag="*", cls="article", role="main", link_cls="dl").collect()
    assert [(r.main_text, r.links) for r in got] == [("yes and more", ["/1?a&b", "/2"]), (None, []), ("", [])]
    assert [r.download_url for r in text.download_link(pages, "http://s", link_cls="dl").collect()] == ["http://s/1?a&b", None, None]


def test_elements_that_are_not_closed(spark):
    pages = spark.createDataFrame([("<article><p>one<b>two</article><footer>foot</footer></p><article>three</i> four</article>end",)], "html string")
    assert text.main_text(pages).first().main_text == "onetwothree four"
