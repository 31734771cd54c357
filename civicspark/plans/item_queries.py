"""Registered queries of news, map items, upserts, gazetteer and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.functions import geo, text
from civicspark.functions.geo import GEOMETRY, POINT
from civicspark.operators import gazetteer, items, merge, spatial
from civicspark.operators.versions import SnapshotStore
from civicspark.plans.derived import as_of, geo_items, haversine_sql, lat, lng, query_points, subscriptions, table, with_tables
from civicspark.plans.derived import gazetteer as places_of_words
from civicspark.plans.spatial_queries import SINCE, _dated, _since
from civicspark.storage import dealt, shared_folder
from civicspark.streaming.jobs import digest_items, digest_windows, ingest, landed

KINDS = ("street", "street_number", "place")


def _kind(c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), (c % 3 + 1).cast("int"))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    named = li.select(F.col("l_orderkey").alias("news_item_id"), _kind(F.col("l_linenumber")).alias("kind"), F.col("l_partkey").alias("target_id"))
    return dealt(named, li.count(), "news_item_id", "kind", "target_id").distinct()


def _gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is a street, a house number and a place; some have no point, some a line, some neither."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target_id"), F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("kind"))
    point = F.struct(lng("target_id").alias("lng"), lat("target_id").alias("lat"))
    line = geo.line(F.array(point, F.struct((lng("target_id") + 0.25).alias("lng"), lat("target_id").alias("lat"))))
    k = F.col("target_id")
    return p.select("kind", "target_id", F.when(k % 3 > 0, point).cast(POINT).alias("point"), F.when((k % 4 == 0) & (F.col("kind") != "street_number"), line).cast(GEOMETRY).alias("geometry"))


def news_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions, cached geometries and representative point of every news item that has any."""
    mentions, places = _mentions(spark, sf_dir), _gazetteer(spark, sf_dir)
    both = items.positions_of_news(mentions, places).select("news_item_id", "positions", *items.geometries_of_positions())
    p = items.news_point(F.col("geo_points"), F.col("geometries"))
    first, last = F.get("positions", F.lit(0)), F.element_at("positions", -1)
    return both.select(
        "news_item_id", F.size("positions").cast("long").alias("n_positions"), first["type"].alias("first_type"), first["id"].alias("first_id"), last["type"].alias("last_type"),
        last["id"].alias("last_id"), F.coalesce(F.size("geometries"), F.lit(0)).cast("long").alias("n_geometries"), F.coalesce(F.size("geo_points"), F.lit(0)).cast("long").alias("n_points"),
        F.round(p["lng"], 6).alias("p_lng"),
    )


def geometry_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached geometries of news, made from a part of mentions and gazetteer and brought up to the whole by what was missing."""
    mentions, places = _mentions(spark, sf_dir), _gazetteer(spark, sf_dir)
    some, known = mentions.where("news_item_id % 5 > 0"), places.where("target_id % 11 > 0")
    store = SnapshotStore(spark, shared_folder(spark, "geometries"), ["news_item_id"], 16)
    store.store(items.cached_geometries(some, known))
    changes, _ = items.refresh_geometries(store.read(), mentions, places, mentions.where("news_item_id % 5 = 0"), places.where("target_id % 11 = 0"))
    store.change(changes)
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return store.read().select("news_item_id", count("geometries").alias("n_geometries"), count("geo_points").alias("n_points"))


def _news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as news with two points, every tenth with a line too."""
    o = table(spark, sf_dir, "orders").withColumn("other", F.col("o_orderkey") + 333)
    a = F.struct(lng("o_orderkey").alias("lng"), lat("o_orderkey").alias("lat"))
    b = F.struct(lng("other").alias("lng"), lat("other").alias("lat"))
    c = F.struct((lng("o_orderkey") + 0.03).alias("lng"), lat("o_orderkey").alias("lat"))
    shape = F.when(F.col("o_orderkey") % 10 == 0, F.array(geo.line(F.array(a, c)))).cast(f"array<{GEOMETRY}>")
    position = lambda p: F.struct(F.lit("street").alias("type"), F.col("o_orderkey").alias("id"), p.alias("point"), F.lit(None).cast(GEOMETRY).alias("geometry"))
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), (F.col("o_orderkey") % 35 == 0).alias("hidden"), F.col("o_orderdate").alias("published_at"),
        F.array(a, b).cast(f"array<{POINT}>").alias("geo_points"), shape.alias("geometries"), F.array(position(a), position(b)).alias("positions"),
    )


def near_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spatial.nearest_news(query_points(spark, sf_dir), _news(spark, sf_dir), 10)
    return out.select("query_id", "id", F.col("near_rank").cast("long").alias("near_rank"), F.round("dist_deg", 9).alias("dist_deg"))


def near_both_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spatial.near_both(query_points(spark, sf_dir), _dated(spark, sf_dir), _news(spark, sf_dir), 10, as_of())
    return out.select("query_id", "kind", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def polygon_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's triangle with a hole against a point in it, in the hole, or outside."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), lng("c_custkey").alias("x"), lat("c_custkey").alias("y"))
    at = lambda dx, dy: F.struct((F.col("x") + dx).alias("lng"), (F.col("y") + dy).alias("lat"))
    ring = lambda k, *p: F.struct(F.lit("polygon").alias("kind"), F.lit(0).alias("part"), F.lit(k).alias("ring"), F.array(*[at(*q) for q in (*p, p[0])]).alias("coords"))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring(0, (0.0, 0.0), (0.5, 0.0), (0.0, 0.5)), ring(1, (0.0625, 0.0625), (0.125, 0.0625), (0.125, 0.125), (0.0625, 0.125))).alias("parts"))
    step = F.element_at(F.array(*[F.lit(v) for v in (0.03125, 0.09375, 0.1875, 0.375, -0.125)]), (F.col("id") % 5 + 1).cast("int"))
    px, py = F.col("x") + step, F.col("y") + step
    return c.withColumn("shape", shape).select("id", F.round(geo.distance(F.col("shape"), px, py), 9).alias("degrees"))


def detail_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(_kind(F.col("l_linenumber")).alias("kind"), F.col("l_partkey").alias("target_id"), F.col("l_orderkey").alias("news_item_id"))
    return items.collapse_single_news(li.distinct())


def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("subtitle", F.when(k % 4 == 0, F.lit("  ")).when(k % 4 == 1, F.concat(F.lit(" S "), k.cast("string"))))
    return o.select("o_orderkey", items.display_text(F.col("subtitle"), F.when(k % 3 > 0, F.col("o_orderpriority"))).alias("shown"), text.is_blank(F.col("subtitle")).alias("is_blank"))


def house_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows a street name, and what of it is a number."""
    li = table(spark, sf_dir, "lineitem")
    n, k = F.col("l_partkey").cast("string"), F.col("l_linenumber")
    tail = F.concat(n, F.element_at(F.array(*[F.lit(x) for x in ("", " a bc", "/70", " wird", "-b", "  Q")]), (k % 6 + 1).cast("int")))
    tail = F.when(k % 7 == 0, F.concat(F.lit("x"), tail)).otherwise(tail)
    number = text.house_number(tail)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", tail.alias("tail"), number.alias("number"), text.strip_letter(number).alias("plain"), text.number_normalize(tail).alias("stored"))


def name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gazetteer.candidates_by_name(places_of_words(spark, sf_dir))
    return found.select("name", F.size("candidates").cast("long").alias("n"), F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c.id, c.district, c.type)), "|").alias("found"))


def gazetteer_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places to which others come, of which some replace old ones."""
    places = places_of_words(spark, sf_dir)
    more = places.where("id % 2 = 0").withColumn("id", F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(-F.col("id"))).withColumn("type", F.lit("New"))
    return gazetteer.grow(places, more).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


def query_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit(" !(Ä-")), F.lit(" ) "))
    return table(spark, sf_dir, "part").select("p_partkey", text.format_query(typed).alias("formatted"), F.array_join(text.search_tokens(typed), " ").alias("tokens"))


def float_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, k = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    n = F.col("l_partkey").cast("string")
    given = F.element_at(F.array(n, F.concat(n, F.lit(".25abc")), F.lit("abc"), F.lit(""), F.lit(None).cast("string"), F.concat(F.lit("-"), n, F.lit(".5e1"))), (k % 6 + 1).cast("int"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", text.float_or(given, 52.5).alias("number"))


def entity_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written with entities, named and numbered, and read back."""
    written = F.col("text")
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&#62;"), ('"', "&quot;"), ("e", "&#101;"), ("ü", "&uuml;"), ("ß", "&szlig;"), ("é", "&#xe9;")):
        written = F.replace(written, F.lit(plain), F.lit(entity))
    return table(spark, sf_dir, "documents").select("doc_id", text.html_unescape(written).alias("decoded"))


def map_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of the map documents of all items within reach of the query points, read back from their JSON."""
    found = _dated(spark, sf_dir).withColumns({"lng": F.when(F.col("id") % 6 > 0, F.col("lng")), "state": F.lit(None).cast("string")})
    found = found.withColumn("title", F.when(F.col("id") % 4 > 0, F.concat(F.lit('"'), "title", F.lit('"'))))
    sources = table(spark, sf_dir, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").cast("long").alias("source_id"), F.col("n_name").alias("short_name"), F.lit("#aabbcc").alias("color"))
    shape = (
        "struct<type:string,id:bigint,title:string,participation_open:boolean,source:string,color:string,"
        "positions:array<struct<type:string,id:bigint,point:struct<lat:double,lng:double>>>>"
    )
    out = items.map_documents(found, sources, F.col("id")).withColumn("d", F.from_json("document", shape))
    p = F.get("d.positions", F.lit(0))
    has = lambda name: F.contains("document", F.lit(f'"{name}":'))
    return out.select(
        "id", F.col("d.type").alias("type"), "d.title", "d.participation_open", "d.source", "d.color", p["type"].alias("p_type"), p["id"].alias("p_id"), F.round(p["point"]["lng"], 6).alias("p_lng"),
        has("title").alias("has_title"), has("source").alias("has_source"), has("point").alias("has_point"),
    )


def feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the feeds around all query points."""
    places = query_points(spark, sf_dir).withColumn("radius_m", F.lit(2000))
    found = spatial.within_metres(places, geo_items(spark, sf_dir), as_of() - F.expr("interval 28 days"))
    found = found.withColumns({"lng": F.round("lng", 3), "lat": F.round("lat", 3), "description": F.concat("title", F.lit(" & <more>\n\nsecond\nline"))})
    return items.feed_rows(found, "https://site")


def by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that large lineitems name, of one source."""
    wanted = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("id"))
    return items.by_natural_key(items.by_ids(geo_items(spark, sf_dir), wanted), source_id=3).select("id", "title")


def source_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the nations are known sources; a batch gives some of them and the others a colour."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("short_name"), F.lit("#000000").alias("color"))
    old = n.where("id % 2 = 0").withColumns({"inserted_at": F.lit("2000-01-01").cast("timestamp_ntz"), "updated_at": F.lit("2000-01-01").cast("timestamp_ntz")})
    batch = n.where("id % 3 = 0").select("short_name", F.concat(F.lit("#"), F.col("id").cast("string")).alias("color"), F.col("id").alias("seq"))
    return merge.merge_snapshot(old, batch, ["short_name"], as_of()).select("short_name", "color", "inserted_at", "updated_at")


def place_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that are loaded again lose what the new file does not say."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("external_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("district"))
    old = p.where("id % 2 = 0").withColumns({"inserted_at": F.lit("2000-01-01").cast("timestamp_ntz"), "updated_at": F.lit("2000-01-01").cast("timestamp_ntz")})
    batch = p.where("id % 3 = 0").select("external_id", F.upper("name").alias("name"), F.when(F.col("id") % 4 == 0, F.col("district")).alias("district"), F.col("id").alias("seq"))
    return merge.merge_snapshot(old, batch, ["external_id"], as_of(), replace=True).select("external_id", "name", "district", "inserted_at", "updated_at")


def news_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News of open orders come, those of urgent ones come again with other mentions."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    news = o.select(k.alias("id"), (k % 5).alias("source_id"), k.cast("string").alias("external_id"), F.col("o_orderpriority").alias("title"), "o_orderstatus", F.col("o_orderdate").alias("inserted_at"))
    old = news.where("o_orderstatus <> 'O'").drop("o_orderstatus").withColumn("updated_at", F.col("inserted_at"))
    batch = news.where("o_orderstatus = 'O' or title = '1-URGENT'").select("source_id", "external_id", F.lower("title").alias("title"), F.col("id").alias("seq"))
    before = old.select(F.col("id").alias("news_item_id"), F.lit("street").alias("kind"), (F.col("id") % 10).alias("target_id"))
    # no mention in every seventh text
    said = batch.where("seq % 7 > 0").select("source_id", "external_id", F.lit("place").alias("kind"), F.explode(F.array(F.col("seq") % 3, F.col("seq") % 4)).alias("target_id"))
    after, mentions = merge.upsert_news(old, batch, before, said, as_of())
    told = mentions.groupBy(F.col("news_item_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "target_id"))), ",").alias("mentions"))
    return after.join(told, "id", "left").select("source_id", "external_id", "title", "inserted_at", "updated_at", F.coalesce("mentions", F.lit("")).alias("mentions"))


def subscription_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three places for each customer, two of them subscribed; orders subscribe, update and unsubscribe near them."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), lng("c_custkey").alias("lng"), F.explode(F.array(F.lit(0), F.lit(1))).alias("place"), lat("c_custkey").alias("base"))
    subs = c.select((F.col("user_id") * 2 + F.col("place")).alias("sub_id"), "user_id", (500 + 100 * F.col("place")).cast("int").alias("radius_m"), "lng", (F.col("base") + F.col("place") * 0.0625).alias("lat"))
    k = F.col("o_orderkey")
    shift = (k % 3) * F.lit(0.0625) + (k % 2) * F.lit(0.0004)
    op = F.element_at(F.array(*[F.lit(x) for x in ("subscribe", "update", "unsubscribe", "update", "unsubscribe", "subscribe", "update")]), (k % 7 + 1).cast("int"))
    events = table(spark, sf_dir, "orders").select(
        k.alias("seq"), op.alias("op"), F.col("o_custkey").alias("user_id"), lng("o_custkey").alias("lng"), (lat("o_custkey") + shift).alias("lat"),
        F.when(k % 5 > 0, 100 * (k % 9 + 1)).cast("int").alias("radius_m"),
    )
    out = merge.apply_subscription_events(subs, events)
    return out.select("user_id", F.col("radius_m").cast("long").alias("radius_m"), F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


def ingest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed events as upserts of their users' last state, batch by batch."""
    folder = shared_folder(spark, "ingest")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    events.repartitionByRange(3, "event_id").write.parquet(f"{folder}/in")
    done: list[int] = []

    def apply(batch: DataFrame, number: int) -> None:
        new = batch.select("user_id", F.col("event_type").alias("state"), "value", F.struct("ts", "event_id").alias("seq"))
        if done:
            old = spark.read.parquet(f"{folder}/state-{done[-1]}")
        else:
            old = spark.createDataFrame([], "user_id long, state string, value double, at struct<ts:timestamp_ntz,event_id:bigint>")
        seen = new.unionByName(old.select("user_id", "state", "value", F.col("at").alias("seq")))
        last = merge.last_present(seen, ["user_id"], "seq", ["state", "value", "seq"])
        last.select("user_id", "state", "value", F.col("seq").alias("at")).write.mode("overwrite").parquet(f"{folder}/state-{number}")
        done.append(number)

    stream = landed(spark, f"{folder}/in", events.schema, per_batch=1)
    ingest(stream, f"{folder}/checkpoint", apply).awaitTermination()
    return spark.read.parquet(f"{folder}/state-{done[-1]}").select("user_id", "state", "value", F.col("at.event_id").alias("event_id"))


def digest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that land in two batches, and a digest for each user and batch."""
    folder = shared_folder(spark, "digest")
    fresh = geo_items(spark, sf_dir).where(F.col("inserted_at") >= _since()).select("kind_order", "kind", "id", "inserted_at", "lng", "lat")
    send = lambda digests, number: digests.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
    for part in (0, 1):
        fresh.where(F.col("id") % 2 == part).write.mode("append").parquet(f"{folder}/in")
        digest_items(landed(spark, f"{folder}/in", fresh.schema), lambda: subscriptions(spark, sf_dir), f"{folder}/checkpoint", send).awaitTermination()
    sent = spark.read.parquet(f"{folder}/out")
    return sent.select("user_id", "n_items", F.col("first_item.id").alias("first_id"), F.col("last_item.id").alias("last_id"))


def digest_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as alerts that land in two files, digested for each user and six hours of event time once these are over."""
    folder = shared_folder(spark, "windows")
    e = table(spark, sf_dir, "events").select("user_id", F.lit("geo_item").alias("kind"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("inserted_at"))
    for part in (0, 1):
        e.where(F.col("id") % 2 == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    send = lambda digests, number: digests.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
    digest_windows(landed(spark, f"{folder}/in", e.schema), f"{folder}/checkpoint", send, "6 hours", "12 hours").awaitTermination()
    sent = spark.read.schema("user_id long, start timestamp, items array<struct<kind_order:int,inserted_at:timestamp,id:long,kind:string>>").parquet(f"{folder}/out")
    ids = F.transform("items", lambda x: x["id"])
    return sent.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.size("items").cast("long").alias("n_items"), F.get(ids, F.lit(0)).alias("first_id"), F.element_at(ids, -1).alias("last_id"))


QUERIES = {
    f.__name__: f
    for f in (
        news_positions, geometry_refresh, near_news, near_both_kinds, polygon_distance, detail_collapse, display_texts, house_numbers, name_candidates, gazetteer_growth, query_formats,
        float_defaults, entity_decode, map_json, feed_rows, by_ids, source_upsert, place_replace, news_upsert, subscription_events, ingest_events, digest_stream, digest_hours,
    )
}


def _x(k: str) -> str:
    return f"(cast(13.08 as double) + cast({k} * 7919 % 10007 as double) / cast(10007 as double) * cast(0.68 as double))"


def _y(k: str) -> str:
    return f"(cast(52.33 as double) + cast({k} * 104729 % 10009 as double) / cast(10009 as double) * cast(0.35 as double))"


_POSITIONS = f"""with mentions as (
    select distinct l_orderkey as id, l_linenumber % 3 as o, (['street', 'street_number', 'place'])[l_linenumber % 3 + 1] as kind, l_partkey as k from lineitem join part on p_partkey = l_partkey
), placed as (
    select *, case when k % 3 > 0 then {_x("k")} end as x, k % 4 = 0 and o <> 1 as shaped from mentions where k % 3 > 0 or k % 4 = 0 and o <> 1
)"""
_NEWS = f"""news as (
    select o_orderkey as id, o_orderkey % 35 = 0 as hidden, o_orderdate as published_at, {_x("o_orderkey")} as xa, {_y("o_orderkey")} as ya,
           {_x("(o_orderkey + 333)")} as xb, {_y("(o_orderkey + 333)")} as yb from orders
), far as (
    select q.*, n.*, least(sqrt((xa - q_lng) * (xa - q_lng) + (ya - q_lat) * (ya - q_lat)), sqrt((xb - q_lng) * (xb - q_lng) + (yb - q_lat) * (yb - q_lat)),
        case when id % 10 = 0 then sqrt(pow(greatest(xa - q_lng, q_lng - (xa + 0.03), 0), 2) + (ya - q_lat) * (ya - q_lat)) else 9 end) as dist_deg
    from query_points q, news n where not hidden
), near_n as (
    select * from (select *, row_number() over (partition by query_id order by dist_deg, id) as near_rank from far where dist_deg <= 0.05) where near_rank <= 10
)"""

ORACLES = {
    "news_positions": _POSITIONS
    + f""" select id as news_item_id, count(*) as n_positions, arg_min(kind, (o, k)) as first_type, arg_min(k, (o, k)) as first_id, arg_max(kind, (o, k)) as last_type, arg_max(k, (o, k)) as last_id,
        count(*) filter (where shaped) as n_geometries, count(x) as n_points,
        round(coalesce(arg_min(x, (o, k)) filter (where x is not null), arg_min({_x("k")} + 0.125, (o, k)) filter (where shaped)), 6) as p_lng from placed group by id""",
    "geometry_refresh": _POSITIONS + " select id as news_item_id, count(*) filter (where shaped) as n_geometries, count(x) as n_points from placed group by id",
    "near_news": with_tables("query_points") + ", " + _NEWS + " select query_id, id, near_rank, round(dist_deg, 9) as dist_deg from near_n",
    "near_both_kinds": with_tables("query_points", "geo_items")
    + ", "
    + _NEWS
    + f""", near_g as (
    select * from (
        select *, row_number() over (partition by query_id order by dist_deg, id) as near_rank from (
            select q.*, i.*, sqrt((i.lng - q.q_lng) * (i.lng - q.q_lng) + (i.lat - q.q_lat) * (i.lat - q.q_lat)) as dist_deg
            from query_points q join geo_items i on not i.hidden and i.lng between q.q_lng - 0.051 and q.q_lng + 0.051) where dist_deg <= 0.05) where near_rank <= 10
), united as (
    select query_id, 'geo_item' as kind, 0 as kind_order, id, dist_deg, participation_open, {haversine_sql("q_lng", "q_lat", "lng", "lat")} as m,
           (case when date_end is null or abs(trunc(epoch(date_start - timestamp '2001-08-01') / 86400)) <= abs(trunc(epoch(date_end - timestamp '2001-08-01') / 86400)) then date_start else date_end end) as newest
    from near_g
    union all select query_id, 'news_item', 1, id, dist_deg, false, least({haversine_sql("q_lng", "q_lat", "xa", "ya")}, {haversine_sql("q_lng", "q_lat", "xb", "yb")}), published_at from near_n
), scored as (
    select *, abs(trunc(epoch(timestamp '2001-08-01' - newest) / 604800)) >= 6 as is_old,
           m / 10 + case when newest <= timestamp '2001-08-01' then datesub('month', newest, timestamp '2001-08-01') else -datesub('month', timestamp '2001-08-01', newest) end
           - case when participation_open then 30 else 0 end as score
    from united where newest > timestamp '1996-08-01'
)
select query_id, kind, id, rank, round(score, 6) as score from (
    select *, row_number() over (partition by query_id order by is_old, score, kind_order, dist_deg, id) as rank from scored) where rank <= 10""",
    "polygon_distance": """select c_custkey as id, round(([0, 0.03125, 0, 0.25 / sqrt(2), 0.125 * sqrt(2)])[c_custkey % 5 + 1], 9) as degrees from customer""",
    "detail_collapse": """with d as (
    select distinct (['street', 'street_number', 'place'])[l_linenumber % 3 + 1] as kind, l_partkey as target_id, l_orderkey as news_item_id from lineitem
), counted as (select *, count(*) over (partition by kind, target_id) = 1 as alone from d)
select kind, target_id, news_item_id, case when alone then 'news_item' else kind end as shown_kind, case when alone then news_item_id else target_id end as shown_id from counted""",
    "display_texts": """select o_orderkey, case when o_orderkey % 4 = 1 then 'S ' || o_orderkey when o_orderkey % 3 > 0 then o_orderpriority end as shown, o_orderkey % 4 <> 1 as is_blank from orders""",
    "house_numbers": r"""with t as (
    select *, case when l_linenumber % 7 = 0 then 'x' else '' end || l_partkey || (['', ' a bc', '/70', ' wird', '-b', '  Q'])[l_linenumber % 6 + 1] as tail from lineitem
)
select l_orderkey, l_linenumber, l_partkey, tail,
       case when l_linenumber % 7 > 0 then l_partkey || (['', 'A', '', 'W', '', 'Q'])[l_linenumber % 6 + 1] end as number, case when l_linenumber % 7 > 0 then cast(l_partkey as varchar) end as plain,
       upper(replace(tail, ' ', '')) as stored from t""",
    "name_candidates": with_tables("gazetteer")
    + " select name, count(*) as n, string_agg(id || ':' || district || ':' || type, '|' order by id) as found from gazetteer group by name",
    "gazetteer_growth": with_tables("gazetteer")
    + """, grown as (
    select id, type from gazetteer where id % 4 <> 0 union all select case when id % 4 = 0 then id else -id end, 'New' from gazetteer where id % 2 = 0
) select type, count(*) as n, count(distinct id) as ids from grown group by type""",
    "query_formats": """with p as (select p_partkey, string_split(p_name, ' ') as w from part)
select p_partkey, array_to_string(list_transform(w, lambda x, i: case when i > 1 then 'Ä:* & ' else '' end || x || ':*'), ' & ') as formatted,
       array_to_string(list_transform(w, lambda x, i: case when i > 1 then 'a ' else '' end || lower(x)), ' ') as tokens from p""",
    "float_defaults": """select l_orderkey, l_linenumber, l_partkey,
    ([cast(l_partkey as double), l_partkey + cast(0.25 as double), 52.5, 52.5, 52.5, -(l_partkey + cast(0.5 as double)) * 10])[l_linenumber % 6 + 1] as number from lineitem""",
    "entity_decode": "select doc_id, text as decoded from documents",
    "map_json": with_tables("geo_items")
    + """ select id, kind as type, case when id % 4 > 0 then '"' || title || '"' end as title, participation_open, n_name as source, case when n_name is not null then '#aabbcc' end as color,
        'geo_item' as p_type, id as p_id, case when id % 6 > 0 then round(lng, 6) end as p_lng, true as has_title, true as has_source, id % 6 > 0 as has_point
    from geo_items left join nation on n_nationkey = source_id and n_nationkey <> 3""",
    "feed_rows": with_tables("query_points", "geo_items")
    + f""" select query_id, 'https://site/map?lat=' || cast(round(lat, 3) as varchar) || '&lng=' || cast(round(lng, 3) as varchar) || '&details=' || id || '&detailsType=geo_item' as entry_id, title,
        strftime(inserted_at, '%d.%m.%Y') as updated, '<p>' || title || ' &amp; &lt;more&gt;</p>' || chr(10) || '<p>second<br>' || chr(10) || 'line</p>' as content from query_points q
    join geo_items i on inserted_at >= timestamp '2001-08-01' - interval 28 days and {haversine_sql("q.q_lng", "q.q_lat", "i.lng", "i.lat")} <= 2000""",
    "by_ids": with_tables("geo_items") + " select id, title from geo_items where source_id = 3 and id in (select l_orderkey from lineitem where l_quantity >= 45)",
    "source_upsert": """select n_name as short_name, case when n_nationkey % 3 = 0 then '#' || n_nationkey else '#000000' end as color,
        case when n_nationkey % 2 = 0 then timestamp '2000-01-01' else timestamp '2001-08-01' end as inserted_at,
        case when n_nationkey % 3 = 0 then timestamp '2001-08-01' else timestamp '2000-01-01' end as updated_at from nation where n_nationkey % 2 = 0 or n_nationkey % 3 = 0""",
    "place_replace": """select cast(p_partkey as varchar) as external_id, case when p_partkey % 3 = 0 then upper(p_name) else p_name end as name,
        case when p_partkey % 3 > 0 or p_partkey % 4 = 0 then p_brand end as district,
        case when p_partkey % 2 = 0 then timestamp '2000-01-01' else timestamp '2001-08-01' end as inserted_at,
        case when p_partkey % 3 = 0 then timestamp '2001-08-01' else timestamp '2000-01-01' end as updated_at from part where p_partkey % 2 = 0 or p_partkey % 3 = 0""",
    "news_upsert": """with n as (
    select *, o_orderstatus = 'O' as fresh, o_orderstatus = 'O' or o_orderpriority = '1-URGENT' as told from orders
)
select o_orderkey % 5 as source_id, cast(o_orderkey as varchar) as external_id, case when told then lower(o_orderpriority) else o_orderpriority end as title,
       case when fresh then timestamp '2001-08-01' else o_orderdate end as inserted_at, case when told then timestamp '2001-08-01' else o_orderdate end as updated_at,
       case when not told then 'street:' || (o_orderkey % 10) when o_orderkey % 7 = 0 then '' when o_orderkey % 3 = o_orderkey % 4 then 'place:' || (o_orderkey % 3)
            else 'place:' || least(o_orderkey % 3, o_orderkey % 4) || ',place:' || greatest(o_orderkey % 3, o_orderkey % 4) end as mentions
from n""",
    "subscription_events": f"""with e as (
    select o_custkey as user_id, o_orderkey as seq, (['subscribe', 'update', 'unsubscribe', 'update', 'unsubscribe', 'subscribe', 'update'])[o_orderkey % 7 + 1] as op, o_orderkey % 3 as place,
           (o_orderkey % 2) * cast(0.0004 as double) as shift, case when o_orderkey % 5 > 0 then 100 * (o_orderkey % 9 + 1) end as radius from orders
    union all select c_custkey, -1, 'subscribe', p, 0, 500 + 100 * p from customer, range(0, 2) t(p)
), gone as (
    select user_id, place, max(seq) filter (where op = 'unsubscribe') as u from e group by user_id, place
), made as (
    select user_id, place, min(seq) as s from e join gone using (user_id, place) where op = 'subscribe' and seq > coalesce(u, -2) group by user_id, place
), last as (
    select user_id, place, s, arg_max(radius, seq) filter (where radius is not null) as radius from e join made using (user_id, place) where seq >= s group by user_id, place, s
)
select l.user_id, cast(coalesce(l.radius, 2000) as bigint) as radius_m, round({_x("l.user_id")}, 6) as lng, round({_y("l.user_id")} + l.place * cast(0.0625 as double) + e.shift, 6) as lat
from last l join e on e.user_id = l.user_id and e.place = l.place and e.seq = l.s""",
    "ingest_events": """select user_id, arg_max(event_type, (ts, event_id)) as state, arg_max(value, (ts, event_id)) as value, arg_max(event_id, (ts, event_id)) as event_id from events group by user_id""",
    "digest_hours": """with w as (
    select user_id, event_id as id, ts, time_bucket(interval 6 hours, ts, timestamp '1970-01-01') as start from events
), over_at as (select max(ts) - interval 12 hours as watermark from events)
select user_id, start, count(*) as n_items, arg_min(id, (ts, id)) as first_id, arg_max(id, (ts, id)) as last_id
from w, over_at where start + interval 6 hours <= date_trunc('millisecond', watermark) group by user_id, start""",
    "digest_stream": with_tables("subscriptions", "geo_items")
    + f""", alerted as (
    select distinct s.user_id, i.id, i.inserted_at from subscriptions s
    join geo_items i on i.inserted_at >= timestamp '{SINCE}' and i.lat between s.lat - 0.03 and s.lat + 0.03 and {haversine_sql("s.lng", "s.lat", "i.lng", "i.lat")} <= s.radius_m
) select user_id, count(*) as n_items, arg_min(id, (inserted_at, id)) as first_id, arg_max(id, (inserted_at, id)) as last_id from alerted group by user_id, id % 2""",
}
