"""Landed feed files as canonical items. Files are fetched elsewhere; each reader takes a folder or glob."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.functions.dates import date_range, parse_date, parse_timestamp, quarter_end, quarter_start
from civicspark.functions.geo import GEOMETRY, POINT, center, geojson_geometry
from civicspark.functions.text import districts_of_categories, forum_description, html_unescape, main_text, without_contacts
from civicspark.operators.items import plan_links, plan_open, plan_state, project_state
from civicspark.sources.records import records

#: Columns of every geo item, in order, with their types.
ITEM = {
    "external_id": "string", "title": "string", "subtitle": "string", "description": "string", "url": "string", "state": "string",
    "geo_point": POINT, "geometry": GEOMETRY, "participation_open": "boolean", "additional_link": "string", "additional_link_name": "string",
    "date_start": "timestamp", "date_end": "timestamp", "date_updated": "timestamp", "source": "string", "seq": "long",
}


def canonical(rows: DataFrame, source: str, **values: Column) -> DataFrame:
    """rows as items; what is not given is null, and an empty text is null too."""
    out = []
    for name, kind in ITEM.items():
        c = F.lit(source) if name == "source" else values.get(name, F.lit(None))
        c = c.cast(kind)
        out.append((F.when(c != "", c) if kind == "string" else c).alias(name))
    return rows.select(out)


def point(lng: Column, lat: Column) -> Column:
    x, y = lng.cast("double"), lat.cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("lng"), y.alias("lat")))


def paged_json(spark: SparkSession, path: str, element: str, collection: str = "results") -> DataFrame:
    """(item, page, pos): the entries of a collection over all landed pages; files of other pages than success are not landed."""
    raw = spark.read.schema(f"`{collection}` array<{element}>").json(path, multiLine=True)
    return raw.select(F.input_file_name().alias("page"), F.posexplode(collection).alias("pos", "item")).select("item", "page", "pos")


PLAN = "struct<id:bigint,status:string,bplanID:string,planname:string,bereich:string,afs_beschl:string,festsg_am:string,aul_start:string,aul_ende:string,fsg_gvbl_d:string,scan_www:string,grund_www:string>"


def building_plans(spark: SparkSession, plans: str, polygons: str) -> DataFrame:
    """Building plans with the polygons of their areas, where there are any."""
    rows = paged_json(spark, plans, PLAN).select("item.*", "pos")
    shapes = geojson_features(spark, polygons)
    shapes = shapes.select(F.get_json_object("properties", "$.pk").cast("long").alias("pk"), "shape").groupBy("pk").agg(F.first("shape").alias("shape"))
    rows = rows.join(shapes, rows.id == shapes.pk, "left")
    days = [parse_date(F.col(c)).cast("timestamp") for c in ("fsg_gvbl_d", "aul_start", "aul_ende", "festsg_am", "afs_beschl")]
    first, last = date_range(*days)
    url, more, name = plan_links(F.col("scan_www"), F.col("grund_www"))
    return canonical(
        rows, "building_plans", external_id=F.col("bplanID"), title=F.concat(F.col("planname"), F.lit(" - "), F.col("bereich")), url=url,
        geometry=geojson_geometry(F.col("shape")), participation_open=plan_open(F.col("status")), state=plan_state(F.col("status")), date_start=first,
        date_end=last, additional_link=more, additional_link_name=name, seq=F.col("pos"),
    )


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, shape, properties) of feature collections of any layout, the last two JSON texts; pos is the feature's byte in its file."""
    f = F.col("value")
    return records(spark, path, "features").select("file", "pos", F.get_json_object(f, "$.geometry").alias("shape"), F.get_json_object(f, "$.properties").alias("properties"))


def _kml_coords(c: Column) -> Column:
    pairs = F.filter(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda p: p != "")
    return F.transform(pairs, lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("lng"), F.split(p, ",")[1].cast("double").alias("lat")))


def _kml_texts(c: Column, path: str, needs: str) -> Column:
    """The texts at a path of a KML text; one without the name that the path needs is not parsed."""
    return F.when(F.contains(c, F.lit(needs)), F.xpath(c, F.lit(path))).otherwise(F.array().cast("array<string>"))


def with_kml(rows: DataFrame, kml: str) -> DataFrame:
    """rows with kml_point, the first point placemark of a KML text, and kml_shape, the first placemark that is no point: lines, polygons by
    their outer ring, and collections of them.

    What is parsed is a column of its own, as an expression that is used several times would parse the text as often.
    """
    c, coordinates = F.col(kml), "*[local-name()='coordinates']/text()"
    base = "//*[local-name()='Placemark'][not(*[local-name()='Point'])][1]"
    rows = rows.withColumns({
        "_points": _kml_texts(c, f"//*[local-name()='Placemark']/*[local-name()='Point']/{coordinates}", "Point"),
        "_lines": _kml_texts(c, f"{base}//*[local-name()='LineString']/{coordinates}", "LineString"),
        "_outer": _kml_texts(c, f"{base}//*[local-name()='outerBoundaryIs']//{coordinates}", "outerBoundaryIs"),
    })

    def part(kind: str, shift: Column):
        return lambda t, k: F.struct(F.lit(kind).alias("kind"), (k + shift).cast("int").alias("part"), F.lit(0).alias("ring"), _kml_coords(t).alias("coords"))

    lines = F.col("_lines")
    rows = rows.withColumn("_parts", F.concat(F.transform(lines, part("line", F.lit(0))), F.transform("_outer", part("polygon", F.size(lines)))))
    kind = F.when(F.size("_parts") > 1, "GeometryCollection").when(F.size(lines) == 1, "LineString").otherwise("Polygon")
    shape = F.when(F.size("_parts") > 0, F.struct(kind.alias("type"), F.col("_parts").alias("parts")))
    rows = rows.withColumns({"kml_point": F.get(_kml_coords(F.get("_points", F.lit(0))), F.lit(0)), "kml_shape": shape})
    return rows.drop("_points", "_lines", "_outer", "_parts")


def bike_projects(spark: SparkSession, path: str) -> DataFrame:
    fields = ("id", "title", "subtitle", "description", "status", "link", "dateStart", "dateEnd", "kml")
    rows = paged_json(spark, path, f"struct<{','.join(f'{f}:string' for f in fields)}>").select("item.*", "pos")
    rows = with_kml(rows.withColumn("kml", F.when(F.col("kml").contains("<"), F.col("kml"))), "kml")
    return canonical(
        rows, "bike_projects", external_id=F.col("id"), title=F.col("title"), subtitle=F.col("subtitle"), description=F.col("description"), url=F.col("link"),
        state=project_state(F.col("status")), geo_point=F.col("kml_point"), geometry=F.col("kml_shape"), date_start=quarter_start(F.col("dateStart")),
        date_end=quarter_end(F.col("dateEnd")), seq=F.col("pos"),
    )


PARTICIPATION = "url string, title string, organisation string, description string, status int, participation int, created_or_modified string, point string"


def participation(spark: SparkSession, *paths: str, site: str = "https://mein.berlin.de") -> DataFrame:
    """The union of landed arrays of projects and of plans."""
    # the JSON source seeks in its file for each object that is read as a text, as points are; from_json() does not
    raw = reduce(DataFrame.unionByName, [spark.read.text(p, wholetext=True) for p in paths]).where(F.trim("value") != "")
    whole = raw.select(F.from_json("value", f"array<struct<{PARTICIPATION}>>").alias("rows"))
    none = F.array(F.lit(None).cast(f"struct<{PARTICIPATION}>"))  # a file that is no JSON is a row of nulls
    rows = whole.select(F.coalesce("rows", none).alias("rows")).select(F.inline("rows"))
    shape = F.get_json_object("point", "$.geometry")
    is_point = F.get_json_object(shape, "$.type") == "Point"
    # a column of its own is parsed once for all its uses
    rows = rows.withColumn("xy", F.when(is_point, F.from_json(F.get_json_object(shape, "$.coordinates"), "array<double>")))
    xy = F.col("xy")
    return canonical(
        rows, "participation", external_id=F.col("url"), title=F.col("title"), subtitle=F.col("organisation"), description=F.col("description"),
        url=F.concat(F.lit(site), F.col("url")), state=F.when(F.col("status") == 0, "active").otherwise("finished"), geo_point=point(xy[0], xy[1]),
        participation_open=F.coalesce((F.col("status") == 0) & (F.col("participation") == 0), F.lit(False)), date_updated=parse_timestamp(F.col("created_or_modified")),
    )


def economy_projects(spark: SparkSession, path: str) -> DataFrame:
    rows = geojson_features(spark, path)
    p = lambda name: F.get_json_object("properties", f"$.{name}")
    is_point = F.get_json_object("shape", "$.type") == "Point"
    rows = rows.withColumn("xy", F.when(is_point, F.from_json(F.get_json_object("shape", "$.coordinates"), "array<double>")))
    xy = F.col("xy")
    return canonical(
        rows, "economy_projects", external_id=p("url"), title=p("title"), description=p("description"), url=p("url"), geo_point=point(xy[0], xy[1]),
        date_updated=parse_timestamp(p("modified")), seq=F.col("pos"),
    )


def environmental_markers(spark: SparkSession, path: str, site: str = "https://www.uvp-verbund.de/trefferanzeige?docuuid=") -> DataFrame:
    """A script that assigns an array of positional rows: latitude, longitude, title, id and others."""
    rows = records(spark, path, sep="]").select("pos", F.from_json("value", "array<string>").alias("r"))
    r = lambda k: F.get("r", F.lit(k))
    return canonical(rows, "environmental_markers", external_id=r(3), title=r(2), url=F.concat(F.lit(site), r(3)), geo_point=point(r(1), r(0)), seq=F.col("pos"))


def area_polygon(c: Column) -> Column:
    """"lat,lng,lat,lng…" as a closed polygon; null if any number is bad or the last one lacks its partner."""
    numbers = F.transform(F.split(c, ","), lambda x: F.when(F.trim(x).rlike(r"^-?\d+\.\d+([eE][+-]?\d+)?$"), F.trim(x).cast("double")))
    good = (F.size(numbers) % 2 == 0) & F.forall(numbers, lambda x: x.isNotNull()) & (c != "")
    at = lambda i: F.struct(F.get(numbers, 2 * i + 1).alias("lng"), F.get(numbers, 2 * i).alias("lat"))
    coords = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(numbers) / 2).cast("int") - 1, F.lit(0))), at)
    ring = F.struct(F.lit("polygon").alias("kind"), F.lit(0).alias("part"), F.lit(0).alias("ring"), F.concat(coords, F.array(F.get(coords, F.lit(0)))).alias("coords"))
    return F.when(good, F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("parts")))


def forum_projects(spark: SparkSession, path: str) -> DataFrame:
    """Positional rows of a forum's map; those that are not enabled go."""
    rows = records(spark, path, "rows", sep="]").select("pos", F.from_json("value", "array<string>").alias("r"))
    r = lambda k: F.get("r", F.lit(k))
    day = lambda k: parse_date(r(k)).cast("timestamp")
    return canonical(
        rows.where(r(20) == "1"), "forum_projects", external_id=r(0), title=html_unescape(r(2)), description=forum_description(r(4)),
        url=F.concat(F.lit("https://www.dafmap.de/d/berlin?id="), r(0), F.lit("&mt=0&zoom=17")), geo_point=point(r(16), r(15)), geometry=area_polygon(r(17)),
        additional_link=r(12), additional_link_name=F.lit("Deutsches Architekturforum"), date_start=day(18), date_end=day(19), date_updated=parse_timestamp(r(22)), seq=F.col("pos"),
    )


def press_releases(spark: SparkSession, feed: str, pages: DataFrame, tag: str = "*", cls: str | None = "article", role: str | None = "main") -> DataFrame:
    """(external_id, title, content, url, published_at, full_text, hints) of a feed, with the text of each landed page (url, html)."""
    schema = "title string, link string, description string, category array<string>, pubDate string"
    entries = spark.read.format("xml").option("rowTag", "item").schema(schema).load(feed)
    texts = main_text(pages.select("url", "html"), tag=tag, cls=cls, role=role).select("url", without_contacts(F.col("main_text")).alias("page_text"))
    title, content = html_unescape(F.col("title")), html_unescape(F.col("description"))
    rows = entries.withColumns({"t": title, "c": content}).join(texts, entries.link == texts.url, "left")
    return rows.select(
        F.col("link").alias("external_id"),
        F.col("t").alias("title"),
        F.col("c").alias("content"),
        F.col("link").alias("url"),
        parse_timestamp(F.col("pubDate")).alias("published_at"),
        F.concat_ws("\n", F.coalesce("t", F.lit("")), F.coalesce("c", F.lit("")), F.coalesce("page_text", F.lit(""))).alias("full_text"),
        F.coalesce(districts_of_categories(F.col("category")), F.array().cast("array<string>")).alias("hints"),
    )


def street_csv(spark: SparkSession, path: str) -> DataFrame:
    """Address rows without a header: id;name;number;zip;city;local_center;lng;lat, with seq, which breaks ties of house numbers.

    seq is the row's place: its file, its block of the file and its offset there, which no split of the work changes.
    """
    schema = "external_id string, name string, number string, zip string, city string, local_center string, lng double, lat double"
    rows = spark.read.schema(schema).csv(path, sep=";", header=False)
    return rows.withColumn("seq", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))


def school_csv(spark: SparkSession, path: str) -> DataFrame:
    """Places of type School: BSN;Name;City;Longitude;Latitude, with a header and perhaps a byte order mark."""
    rows = spark.read.csv(path, sep=";", header=True)
    rows = rows.withColumnRenamed(rows.columns[0], rows.columns[0].lstrip("﻿"))
    return rows.select(
        F.col("BSN").alias("external_id"), F.col("Name").alias("name"), F.col("City").alias("city"), F.lit(None).cast("string").alias("district"), F.lit("School").alias("type"),
        point(F.col("Longitude"), F.col("Latitude")).alias("geo_point"), F.lit(None).cast(GEOMETRY).alias("geometry"),
    )


def place_features(features: DataFrame, kind: str, key: str, name: str, district: str, city: str = "Berlin") -> DataFrame:
    """Places from GeoJSON features; the centre of the bounding box places them."""
    p = lambda c: F.get_json_object("properties", f"$.{c}")
    shaped = features.withColumn("geometry", geojson_geometry(F.col("shape")))
    return shaped.select(
        p(key).alias("external_id"), p(name).alias("name"), F.lit(city).alias("city"), p(district).alias("district"), F.lit(kind).alias("type"), center(F.col("geometry")).alias("geo_point"), "geometry"
    )


def parks(spark: SparkSession, path: str) -> DataFrame:
    return place_features(geojson_features(spark, path), "Park", "gml_id", "namenr", "bezirkname")


def planning_areas(spark: SparkSession, path: str) -> DataFrame:
    return place_features(geojson_features(spark, path), "LOR", "PLANUNGSRAUM", "PLANUNGSRAUM", "BEZIRKSNAME")
