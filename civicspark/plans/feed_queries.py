"""Registered queries of the feed readers and the gazette: files derived from the tables are landed, read and projected, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.functions import text
from civicspark.operators import gazetteer, items
from civicspark.plans.derived import lat, lng, table
from civicspark.sources import feeds, gazette
from civicspark.storage import shared_folder

#: Rows of one landed page or file.
PAGE = 1000


#: Layouts of a collection: between head and entries, between entries, after them. A file has one, a folder all of them.
LAYOUTS = (("", ",", ""), ("\n", ",\n", "\n"), (" ", " ,\n  ", "\n\n"), ("\n\t", ",", "\n"))


def _land(rows: DataFrame, page: Column, entry: Column, around: tuple[str, str], name: str, layouts: tuple = LAYOUTS[:1]) -> str:
    """Write entries, one file of about PAGE of them for each page, between two texts, in layouts by turns; their folder.

    The files lie in one folder: a folder for each costs more than its file to make, to commit and to list.
    """
    folder = shared_folder(rows.sparkSession, name)
    whole = rows.groupBy(page.alias("page")).agg(F.collect_list(entry).alias("entries"))
    head, between, tail = (F.element_at(F.array(*[F.lit(x[k]) for x in layouts]), (F.col("page") % len(layouts) + 1).cast("int")) for k in range(3))
    joined = F.call_function("array_join", F.col("entries"), between)
    whole = whole.select("page", F.concat(F.lit(around[0]), head, joined, tail, F.lit(around[1])).alias("value"))
    whole.repartition("page").select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return folder


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("s"), F.floor(F.col("o_orderkey") / PAGE).alias("page"), F.col("o_orderdate").alias("day"),
        F.col("o_orderpriority").alias("priority"), lng("o_orderkey").alias("x"), lat("o_orderkey").alias("y"),
    )


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]), {"ignoreNullFields": "false"})


def _one_of(*values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("k") % len(values) + 1).cast("int"))


def _date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def _day_of(name: str) -> Column:
    return F.date_trunc("day", F.col(name)).cast("timestamp_ntz").alias(name)


def _square(x: str, y: str) -> Column:
    return _text('{"type":"MultiPolygon","coordinates":[[[[', F.col(x), ",", F.col(y), "],[", F.col(x) + 0.5, ",", F.col(y), "],[", F.col(x) + 0.5, ",", F.col(y) + 0.25, "],[", F.col(x), ",", F.col(y), "]]]]}")


def building_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of plans and a collection of their areas."""
    o, k, s = _orders(spark, sf_dir), F.col("k"), F.col("s")
    entry = _json(
        id=k, status=_one_of("aul", "bbg", "imVerfahren", "festg", "other"), bplanID=_text("B-", s), planname=_text("Plan ", s), bereich=F.col("priority"),
        afs_beschl=_date(F.col("day")), festsg_am=F.when(k % 3 == 0, _date(F.col("day") + F.expr("interval 30 days"))), aul_start=F.lit("not a date"), aul_ende=F.lit(None).cast("string"),
        fsg_gvbl_d=F.lit(None).cast("string"), scan_www=F.when(k % 4 > 0, _text("s/", s)), grund_www=F.when(k % 3 > 0, _text("g/", s)),
    )
    plans = _land(o, F.col("page"), entry, ('{"results":[', "]}"), "plans")
    feature = _text('{"type":"Feature","geometry":', _square("x", "y"), ',"properties":{"pk":', s, "}}")
    shapes = _land(o.where("k % 2 = 0"), F.col("page"), feature, ('{"type":"FeatureCollection","features":[', '],"crs":{"type":"name","properties":{"at":[1,{"x":2}]}}}'), "shapes", LAYOUTS)
    out = feeds.building_plans(spark, plans, shapes)
    c = items.item_point(F.col("geo_point"), F.col("geometry"))
    return out.select(
        "external_id", "title", "state", "participation_open", "url", "additional_link", "additional_link_name", _day_of("date_start"), _day_of("date_end"),
        F.round(c.lng, 6).alias("c_lng"), F.round(c.lat, 6).alias("c_lat"),
    )


def bike_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k, s = _orders(spark, sf_dir), F.col("k"), F.col("s")
    at = _text(F.col("x"), ",", F.col("y"), ",0")
    point = _text("<Placemark><Point><coordinates>", at, "</coordinates></Point></Placemark>")
    line = _text("<Placemark><LineString><coordinates>", at, " ", F.col("x") + 0.5, ",", F.col("y"), "\n", F.col("x") + 0.5, ",", F.col("y") + 0.5, "</coordinates></LineString></Placemark>")
    body = F.when(k % 4 == 1, point).when(k % 4 == 2, line).otherwise(F.concat(point, line))
    kml = F.when(k % 4 > 0, _text('<kml xmlns="http://www.opengis.net/kml/2.2"><Document>', body, "</Document></kml>")).otherwise("")
    entry = _json(
        id=s, title=_text("Lane ", s), subtitle=F.lit(""), description=F.col("priority"), status=_one_of("Vorgesehen", "in Vorbereitung", "in Planung", "Abgeschlossen", "in Bau", "?"),
        link=_text("http://l/", s), dateStart=_text(F.quarter("day"), ". Quartal ", F.year("day")), dateEnd=F.lit("soon"), kml=kml,
    )
    out = feeds.bike_projects(spark, _land(o, F.col("page"), entry, ('{"results":[', "]}"), "bikes"))
    n = F.size(F.get(F.col("geometry.parts"), F.lit(0))["coords"]).cast("long")
    return out.select(
        "external_id", "title", "subtitle", "description", "url", "state", F.round("geo_point.lng", 6).alias("p_lng"), F.col("geometry.type").alias("shape"),
        F.when(F.col("geometry").isNotNull(), n).otherwise(-1).alias("n_points"), F.col("date_end").isNull().alias("is_open"),
    )


def participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects and plans in two folders."""
    o, k, s = _orders(spark, sf_dir), F.col("k"), F.col("s")
    shape = _text('{"type":"Feature","geometry":{"type":', F.when(k % 5 == 0, '"LineString"').otherwise('"Point"'), ',"coordinates":[', F.col("x"), ",", F.col("y"), "]}}")
    fields = _json(
        url=_text("/p/", s, "/"), title=_text("Project ", s), organisation=F.col("priority"), description=F.lit(""), status=(k % 2).cast("int"), participation=(k % 3).cast("int"),
        created_or_modified=_text(F.date_format("day", "yyyy-MM-dd HH:mm:ss"), ".000000+02:00"),
    )
    entry = _text(F.expr("left(fields, length(fields) - 1)"), ',"point":', F.when(k % 7 == 0, '""').otherwise(shape), "}")
    o = o.withColumn("fields", fields)
    paths = [_land(o.where(k % 3 == r), F.col("page"), entry, ("[", "]"), "participation") for r in (0, 1)]
    paths.append(_land(o.where(k % 3 == 2), F.col("page"), entry, ("[", "]"), "participation"))
    out = feeds.participation(spark, *paths)
    return out.select(
        "external_id", "title", "subtitle", F.col("description").isNull().alias("bare"), "url", "state", "participation_open", F.round("geo_point.lat", 6).alias("p_lat"),
        F.unix_timestamp("date_updated").alias("updated"),
    )


def economy_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k, s = _orders(spark, sf_dir), F.col("k"), F.col("s")
    geometry = F.when(k % 4 == 0, _text('{"type":"LineString","coordinates":[[1,2],[3,4]]}')).otherwise(_text('{"type":"Point","coordinates":[', F.col("x"), ",", F.col("y"), "]}"))
    properties = _json(title=_text("Work ", s), description=F.col("priority"), url=_text("u/", s), modified=F.date_format("day", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    feature = _text('{"type":"Feature","properties":', properties, ',"geometry":', geometry, "}")
    out = feeds.economy_projects(spark, _land(o, F.col("page"), feature, ('{"type":"FeatureCollection","features":[', "]}"), "economy", LAYOUTS))
    return out.select("external_id", "title", "description", "url", F.round("geo_point.lng", 6).alias("p_lng"), F.unix_timestamp("date_updated").alias("updated"))


def environmental_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, s = _orders(spark, sf_dir), F.col("s")
    row = _text("[", F.col("y"), ",", F.col("x"), ',"Site \\"', s, '\\"","id-', s, '","c","l",[{"id":', s, "}],[]]")
    out = feeds.environmental_markers(spark, _land(o, F.col("page"), row, ("var markers = [", "];"), "markers", LAYOUTS))
    return out.select("external_id", "title", "url", F.round("geo_point.lng", 6).alias("p_lng"), F.round("geo_point.lat", 6).alias("p_lat"))


def forum_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional rows, some of which are not enabled, with areas of which some are broken."""
    o, k, s = _orders(spark, sf_dir), F.col("k"), F.col("s")
    x, y = F.format_string("%.4f", F.col("x")), F.format_string("%.4f", F.col("y"))
    area = _text('"', y, ",", x, ",52.9000,", x, ",52.9000,13.9000", F.when(k % 5 == 0, ',"').when(k % 5 == 1, ',12"').otherwise('"'))
    told = _text('"Neubau ', s, "<br/>hoch &amp; breit DAF-Post: x", s, '"')
    told = F.when(k % 6 == 0, '"nv"').when(k % 6 == 1, '"Noch kein DAF-Post vorhanden."').otherwise(told)
    cells = [s, "0", _text('"N &amp; ', s, '"'), "0", told, *["0"] * 7, _text('"http://f/', s, '"'), "0", "0", F.col("y"), F.col("x"), area, _text('"', _date(F.col("day")), '"'), "null"]
    cells += [F.when(k % 4 == 0, "0").otherwise("1"), "0", _text('"', F.date_format("day", "yyyy-MM-dd'T'HH:mm:ss"), '"'), *["0"] * 6]
    row = _text("[", F.array_join(F.array(*[c.cast("string") if isinstance(c, Column) else F.lit(c) for c in cells]), ","), "]")
    out = feeds.forum_projects(spark, _land(o, F.col("page"), row, ('{"rows":[', "]}"), "forum", LAYOUTS))
    n = F.size(F.get(F.col("geometry.parts"), F.lit(0))["coords"]).cast("long")
    return out.select(
        "external_id", "title", "description", "url", "additional_link", F.round("geo_point.lng", 6).alias("p_lng"), F.when(F.col("geometry").isNotNull(), n).otherwise(-1).alias("n_corners"),
        _day_of("date_start"), F.unix_timestamp("date_updated").alias("updated"),
    )


def press_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of entries and the pages that they link to; some pages are missing."""
    o, k, s = _orders(spark, sf_dir), F.col("k"), F.col("s")
    folder = shared_folder(spark, "press")
    place = _one_of("Bezirk Mitte", "Pankow und Spandau", "Bau")
    stamp = F.date_format("day", "dd MMM yyyy HH:mm:ss")
    feed = o.select(
        _text("Neu &amp; ", s).alias("title"), _text("http://p/", s).alias("link"), F.col("priority").alias("description"), F.array(place, F.lit("Bauen")).alias("category"),
        _text("Fri, ", stamp, " +0200").alias("pubDate"),
    )
    feed.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(folder)
    html = _text("<body><nav>menu</nav><div class='wide article' role='main'><p>Text &lt;", s, "&gt;</p>\n  <p>Ende</p>\n<p>Pressekontakt: ", s, "</p></div><div class='article'>aside</div></body>")
    out = feeds.press_releases(spark, folder, o.where(k % 10 > 0).select(_text("http://p/", s).alias("url"), html.alias("html")))
    return out.select("external_id", "title", "content", F.unix_timestamp("published_at").alias("published"), "full_text", F.array_join("hints", "|").alias("hints"))


def _issues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pages, outline rows) of issues with eight pages: an order is a page with one section, or two where its key is even."""
    o, k, s = _orders(spark, sf_dir), F.col("k"), F.col("s")
    issue, page = F.floor(k / 8).cast("int"), (k % 8 + 1).cast("int")
    file = _text("f/abl_", F.lit(2000) + issue % 20, "_", issue % 52 + 1, "_x.pdf")
    named = o.select("k", "s", issue.alias("issue"), page.alias("page_no"), F.concat(file, F.lit("#"), issue.cast("string")).alias("file"))
    head = F.when(F.col("page_no") == 1, "Ausgegeben zu Berlin am 16. Juli 2021\n").otherwise("")
    broken = F.when(k % 5 == 0, "\n  mit Umbruch").otherwise(" mit Umbruch")
    one = _text("Rest ", s, "\nThema ", s, broken, "\nTitel ", s, "\n\n  Text mit Bau-\nstelle ", s, ".\nMehr: Mitte-\nWest")
    two = F.when(k % 2 == 0, _text("\nWeiteres ", s, "\nNur Text ", s)).otherwise("")
    pages = named.select("file", "page_no", _text("Amtsblatt\nAmtsblatt\n\n", head, one, two, "\nABl. Nr. 1 / 2021").alias("text"))
    start = named.where("page_no = 1")
    entry = lambda rows, pos, page_no, title: rows.select("file", pos.cast("int").alias("pos"), F.lit("1").alias("level"), page_no.cast("string").alias("page"), title.alias("title"))
    col = F.col("page_no")
    rows = entry(start, F.lit(0), F.lit(1), F.when(F.col("issue") % 7 == 6, "b'Deckblatt'").otherwise("b'Inhalt'"))
    rows = rows.unionByName(entry(start, F.lit(1), F.lit(""), F.lit("ohne Seite")))
    rows = rows.unionByName(entry(named, 10 * col, col, F.when(F.col("k") % 11 == 0, _text("Kammer der Versorgungswerke ", F.col("s"))).otherwise(_text(" Thema ", F.col("s"), " mit Umbruch"))))
    rows = rows.unionByName(entry(named.where("k % 2 = 0"), 10 * col + 5, col, _text("Weiteres ", F.col("s"))))
    # in every third issue the editorial part ends with page 6
    late = start.where("issue % 3 = 0")
    return pages, rows.unionByName(entry(late, F.lit(64), F.lit(7), F.lit("Gerichte"))).unionByName(entry(late, F.lit(66), F.lit(7), F.lit("Amtsgericht")))


def gazette_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, rows = _issues(spark, sf_dir)
    out = gazette.news_records(pages, gazette.outline(rows))
    return out.select("external_id", "title", "content", "full_text", F.array_join("hints", "|").alias("topic"), F.col("published_at").cast("timestamp_ntz").alias("published_at"))


def gazette_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies, last pages, dates and numbers of issues."""
    pages, rows = _issues(spark, sf_dir)
    entries = gazette.outline(rows)
    number, volume = gazette.issue()
    good = gazette.accepted(entries).select("file").distinct().withColumn("is_accepted", F.lit(True))
    out = pages.join(gazette.last_pages(entries, pages), "file").join(good, "file", "left")
    return out.select(
        "file", "page_no", text.page_body(F.col("text")).alias("body"), F.col("last_page").cast("long").alias("last_page"), number.cast("long").alias("number"),
        volume.cast("long").alias("volume"), F.coalesce("is_accepted", F.lit(False)).alias("is_accepted"),
    )


def street_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address rows as a CSV file, rows that cannot be used left out, and the streets they make."""
    li, folder = table(spark, sf_dir, "lineitem"), shared_folder(spark, "streets")
    k = F.col("l_orderkey")
    place = F.element_at(F.array(*[F.lit(x) for x in ("Adlershof", "Wedding", "Nowhere", "Mitte")]), (k % 4 + 1).cast("int"))
    number = F.when(k % 9 == 0, F.lit(" ")).otherwise(_text(F.col("l_linenumber"), " ", F.when(F.col("l_partkey") % 2 == 0, "b").otherwise("")))
    rows = li.select(
        _text(k, "-", F.col("l_linenumber"), "-", F.col("l_partkey")), _text("Weg ", k % 1000), number, F.lit("10115"), F.lit("Berlin"), place, lng("l_orderkey"), lat("l_orderkey"),
    )
    rows.write.csv(folder, sep=";", header=False, ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False)
    streets = gazetteer.assemble_streets(gazetteer.number_rows(feeds.street_csv(spark, folder)))
    return streets.select("district", "name", F.col("street_number_count").cast("long").alias("street_number_count"), F.array_join(F.array_sort("numbers"), " ").alias("numbers"))


def place_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parks and planning areas as GeoJSON, a feature a line, and schools as CSV, in one table of places."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_partkey").cast("string").alias("s"), F.col("p_brand").alias("brand"), lng("p_partkey").alias("x"), lat("p_partkey").alias("y"))
    page, head = F.floor(F.col("k") / PAGE), ('{"type":"FeatureCollection","bbox":[1,2],"features":[', "]}")
    feature = lambda properties: _text('{"type":"Feature","properties":', properties, ',"geometry":', _square("x", "y"), "}")
    park = feature(_json(gml_id=_text("g", F.col("s")), namenr=_text("Hain ", F.col("s")), bezirkname=F.col("brand")))
    area = feature(_json(PLANUNGSRAUM=_text("Raum ", F.col("s")), BEZIRKSNAME=F.col("brand")))
    parks, areas = (_land(p.where(f"k % 3 = {r}"), page, c, head, n, LAYOUTS) for r, c, n in ((0, park, "parks"), (1, area, "areas")))
    schools = shared_folder(spark, "schools")
    p.where("k % 3 = 2").select(F.col("s").alias("BSN"), _text("Schule ", F.col("s")).alias("Name"), F.lit("Berlin").alias("City"), F.col("x").alias("Longitude"), F.col("y").alias("Latitude")).write.csv(schools, sep=";", header=True)
    every = feeds.parks(spark, parks).unionByName(feeds.planning_areas(spark, areas)).unionByName(feeds.school_csv(spark, schools))
    return every.select("external_id", "name", "city", "district", "type", F.round("geo_point.lng", 6).alias("p_lng"), F.round("geo_point.lat", 6).alias("p_lat"))


def outline_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of contents as XML files, read back as outlines."""
    o, k, s = _orders(spark, sf_dir), F.col("k"), F.col("s")
    page = F.when(k % 3 == 0, "").otherwise(_text("<pageno>", k % 90, "</pageno>"))
    e = _text('<outline level="', k % 3, "\" title=\"b'Thema &amp; ", s, '\'"><dest>x</dest>', page, "</outline>")
    files = _land(o, F.col("page"), e, ("<outlines>", "</outlines>"), "toc", (("", "\n", ""),))
    out = gazette.outline(gazette.outline_from_xml(spark, files))
    return out.select("title", F.col("level").cast("long").alias("level"), F.coalesce(F.col("page_no").cast("long"), F.lit(-1)).alias("page_no"))


def download_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first link in an element of a class, below all the others that a page has."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    there = _text("<p><a href='/none'>no</a></p><div class='a download-btn'><b><a href='/f/", F.col("page_id"), "?a=1&amp;b'>get</a></b><a href='/second'>2</a></div>")
    marked = pages.withColumn("html", F.replace("html", F.lit("</body>"), F.concat(F.when(F.col("page_id") % 4 > 0, there).otherwise(""), F.lit("</body>"))))
    return text.download_link(marked, "https://site").select("page_id", "download_url")


QUERIES = {
    f"feed_{f.__name__}": f
    for f in (
        building_plans, bike_projects, participation, economy_projects, environmental_markers, forum_projects, press_releases, gazette_sections, gazette_pages,
        street_csv, place_feeds, outline_xml, download_links,
    )
}

_O = """with o as (
    select o_orderkey as k, cast(o_orderkey as varchar) as s, o_orderdate as day, o_orderpriority as priority,
           cast(13.08 as double) + cast(o_orderkey * 7919 % 10007 as double) / cast(10007 as double) * cast(0.68 as double) as x,
           cast(52.33 as double) + cast(o_orderkey * 104729 % 10009 as double) / cast(10009 as double) * cast(0.35 as double) as y
    from orders
)"""
_ISSUES = (
    _O
    + r""", pages as (
    select k, s, k // 8 as issue, k % 8 + 1 as page_no, 'f/abl_' || (2000 + (k // 8) % 20) || '_' || ((k // 8) % 52 + 1) || '_x.pdf#' || (k // 8) as file,
           'Thema ' || s || ' mit Umbruch' as topic from o
), issues as (
    select issue, max(page_no) as n_pages, case when issue % 3 = 0 then 6 else max(page_no) end as last_page from pages group by issue
)"""
)

ORACLES = {
    "feed_building_plans": _O
    + """ select 'B-' || s as external_id, 'Plan ' || s || ' - ' || priority as title, (['in_planning', 'in_planning', 'in_planning', 'finished', null])[k % 5 + 1] as state,
        k % 5 < 3 as participation_open, case when k % 4 > 0 then 's/' || s when k % 3 > 0 then 'g/' || s end as url,
        case when k % 4 > 0 and k % 3 > 0 then 'g/' || s end as additional_link, case when k % 4 > 0 and k % 3 > 0 then 'Begründung' end as additional_link_name,
        date_trunc('day', day) as date_start, date_trunc('day', case when k % 3 = 0 then day + interval 30 days else day end) as date_end,
        case when k % 2 = 0 then round((x + (x + 0.5)) / 2, 6) end as c_lng, case when k % 2 = 0 then round((y + (y + 0.25)) / 2, 6) end as c_lat from o""",
    "feed_bike_projects": _O
    + """ select s as external_id, 'Lane ' || s as title, cast(null as varchar) as subtitle, priority as description, 'http://l/' || s as url,
        (['intended', 'in_preparation', 'in_planning', 'finished', 'under_construction', null])[k % 6 + 1] as state,
        case when k % 4 in (1, 3) then round(x, 6) end as p_lng, case when k % 4 in (2, 3) then 'LineString' end as shape,
        case when k % 4 in (2, 3) then 3 else -1 end as n_points, true as is_open from o""",
    "feed_participation": _O
    + """ select '/p/' || s || '/' as external_id, 'Project ' || s as title, priority as subtitle, true as bare, 'https://mein.berlin.de/p/' || s || '/' as url,
        case when k % 2 = 0 then 'active' else 'finished' end as state, k % 2 = 0 and k % 3 = 0 as participation_open,
        case when k % 7 > 0 and k % 5 > 0 then round(y, 6) end as p_lat, cast(epoch(day) - 7200 as bigint) as updated from o""",
    "feed_economy_projects": _O
    + """ select 'u/' || s as external_id, 'Work ' || s as title, priority as description, 'u/' || s as url, case when k % 4 > 0 then round(x, 6) end as p_lng,
        cast(epoch(day) as bigint) as updated from o""",
    "feed_environmental_markers": _O
    + """ select 'id-' || s as external_id, 'Site "' || s || '"' as title, 'https://www.uvp-verbund.de/trefferanzeige?docuuid=id-' || s as url, round(x, 6) as p_lng, round(y, 6) as p_lat from o""",
    "feed_forum_projects": _O
    + """ select s as external_id, 'N & ' || s as title, case when k % 6 > 1 then 'Neubau ' || s || chr(10) || 'hoch & breit' end as description,
        'https://www.dafmap.de/d/berlin?id=' || s || '&mt=0&zoom=17' as url, 'http://f/' || s as additional_link, round(x, 6) as p_lng,
        case when k % 5 > 1 then 4 else -1 end as n_corners, date_trunc('day', day) as date_start, cast(epoch(day) as bigint) as updated from o where k % 4 > 0""",
    "feed_press_releases": _O
    + """ select 'http://p/' || s as external_id, 'Neu & ' || s as title, priority as content, cast(epoch(day) - 7200 as bigint) as published,
        'Neu & ' || s || chr(10) || priority || chr(10) || case when k % 10 > 0 then 'Text <' || s || '>' || chr(10) || 'Ende' || chr(10) else '' end as full_text,
        (['Mitte', 'Pankow|Spandau', ''])[k % 3 + 1] as hints from o""",
    "feed_gazette_sections": _ISSUES
    + r""", placed as (
    select p.*, i.n_pages, i.last_page, lead(s) over (partition by p.issue order by page_no) as next_s from pages p join issues i using (issue) where p.issue % 7 <> 6
), cut as (
    select *, 10 as n, 'Titel ' || s || chr(10) || chr(10) || 'Text mit Baustelle ' || s || '.' || chr(10) || 'Mehr: Mitte-West' as body, 'Titel ' || s as title,
           'Text mit Baustelle ' || s as content, k % 2 = 1 as runs_on from placed where k % 11 > 0
    union all select * replace ('Weiteres ' || s as topic), 15, 'Nur Text ' || s, 'Nur Text ' || s, '', true from placed where k % 2 = 0
), whole as (
    select *, body || case when runs_on and page_no < last_page and (k + 1) % 11 > 0 and next_s is not null then chr(10) || 'Rest ' || next_s else '' end as t from cut where page_no <= last_page
)
select '/view_pdf/amtsblatt/' || regexp_extract(file, '([^/]*)$', 1) || '?page=' || page_no || '&title=' || replace(title, ' ', '+') as external_id, case when n = 15 then regexp_extract(t, '^([^\n]*)', 1) else title end as title, content, t as full_text,
       topic, timestamp '2021-07-16 13:26:08.003' as published_at from whole""",
    "feed_gazette_pages": _ISSUES
    + r""" select file, page_no, case when page_no = 1 then 'Ausgegeben zu Berlin am 16. Juli 2021' || chr(10) else '' end || 'Rest ' || s || chr(10) || 'Thema ' || s
        || case when k % 5 = 0 then chr(10) || '  mit Umbruch' else ' mit Umbruch' end || chr(10) || 'Titel ' || s || chr(10) || chr(10) || '  Text mit Bau-' || chr(10) || 'stelle ' || s || '.' || chr(10)
        || 'Mehr: Mitte-' || chr(10) || 'West' || case when k % 2 = 0 then chr(10) || 'Weiteres ' || s || chr(10) || 'Nur Text ' || s else '' end as body,
        last_page, issue % 52 + 1 as number, 50 + issue % 20 as volume, issue % 7 <> 6 as is_accepted from pages join issues using (issue)""",
    "feed_street_csv": """ with rows as (
    select (['Treptow-Köpenick', 'Mitte', null, 'Mitte'])[l_orderkey % 4 + 1] as district, 'Weg ' || (l_orderkey % 1000) as name,
           upper(l_linenumber || case when l_partkey % 2 = 0 then 'b' else '' end) as number from lineitem where l_orderkey % 9 > 0
)
select district, name, count(*) as street_number_count, string_agg(number, ' ' order by number) as numbers from rows where district is not null group by district, name""",
    "feed_place_feeds": """ with p as (
    select p_partkey as k, cast(p_partkey as varchar) as s, p_brand as brand,
           cast(13.08 as double) + cast(p_partkey * 7919 % 10007 as double) / cast(10007 as double) * cast(0.68 as double) as x,
           cast(52.33 as double) + cast(p_partkey * 104729 % 10009 as double) / cast(10009 as double) * cast(0.35 as double) as y
    from part
)
select (['g' || s, 'Raum ' || s, s])[k % 3 + 1] as external_id, (['Hain ' || s, 'Raum ' || s, 'Schule ' || s])[k % 3 + 1] as name, 'Berlin' as city,
       case when k % 3 < 2 then brand end as district, (['Park', 'LOR', 'School'])[k % 3 + 1] as type,
       round(case when k % 3 < 2 then (x + (x + 0.5)) / 2 else x end, 6) as p_lng, round(case when k % 3 < 2 then (y + (y + 0.25)) / 2 else y end, 6) as p_lat from p""",
    "feed_outline_xml": _O + """ select 'Thema & ' || s as title, k % 3 as level, case when k % 3 > 0 then k % 90 else -1 end as page_no from o""",
    "feed_download_links": """ select page_id, case when page_id % 4 > 0 and contains(html, '</body>') then 'https://site/f/' || page_id || '?a=1&b' end as download_url from pages""",
}
