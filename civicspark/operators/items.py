"""Items of the map: states, representative points, documents for the map, links, feed rows, details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions.geo import center
from civicspark.functions.text import none_if_blank, text_to_html
from civicspark.storage import dealt, shared_table

#: Codes of building plans, and labels of states.
PLAN_STATES = {"aul": "in_planning", "bbg": "in_planning", "imVerfahren": "in_planning", "festg": "finished"}
PLAN_OPEN = ("aul", "bbg", "imVerfahren")
PROJECT_STATES = {
    "Vorgesehen": "intended",
    "in Vorbereitung": "in_preparation",
    "in Planung": "in_planning",
    "Abgeschlossen": "finished",
    "in Bau": "under_construction",
}
STATE_LABELS = {
    "intended": "Geplant",
    "in_preparation": "In Vorbereitung",
    "in_planning": "In Planung",
    "under_construction": "Im Bau",
    "active": "Aktiv",
    "finished": "Abgeschlossen",
}


def _lookup(table: dict[str, str], c: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def plan_state(c: Column) -> Column:
    return _lookup(PLAN_STATES, c)


def plan_open(c: Column) -> Column:
    return F.coalesce(c.isin(*PLAN_OPEN), F.lit(False))


def project_state(c: Column) -> Column:
    return _lookup(PROJECT_STATES, c)


def state_label(c: Column) -> Column:
    return _lookup(STATE_LABELS, c)


def plan_links(scan: Column, reason: Column) -> tuple[Column, Column, Column]:
    """(url, additional_link, additional_link_name): the plan, or else its reasons; both if both are there."""
    both = (F.length(scan) > 0) & (F.length(reason) > 0)
    return F.coalesce(scan, reason), F.when(both, reason), F.when(both, F.lit("Begründung"))


def display_text(subtitle: Column, description: Column) -> Column:
    return F.coalesce(none_if_blank(F.trim(subtitle)), none_if_blank(F.trim(description)))


def item_point(point: Column, geometry: Column) -> Column:
    """A geo item's point, or else the centre of its geometry."""
    return F.coalesce(F.when(point["lng"].isNotNull(), point), center(geometry))


def news_point(points: Column, geometries: Column) -> Column:
    """A news item's first point, or else the centre of its first geometry."""
    return F.coalesce(F.get(points, F.lit(0)), center(F.get(geometries, F.lit(0))))


def detail_link(point: Column, item_id: Column, kind: Column) -> Column:
    at = F.when(point.isNotNull(), F.concat(F.lit("lat="), point["lat"].cast("string"), F.lit("&lng="), point["lng"].cast("string"), F.lit("&"))).otherwise(F.lit(""))
    return F.concat(F.lit("/map?"), at, F.lit("details="), F.url_encode(item_id.cast("string")), F.lit("&detailsType="), F.url_encode(kind))


def map_documents(found: DataFrame, sources: DataFrame, *keep: Column) -> DataFrame:
    """keep, and document: one JSON text per item for the map, with its source's colour.

    found: kind, id, title, lng, lat and perhaps geometry, positions, source_id, participation_open. The item's own
    fields stay though they are null; a point or geometry that is missing is left out of a position.
    """
    if "positions" in found.columns:
        positions = F.col("positions")
    else:
        point = F.when(F.col("lng").isNotNull() & F.col("lat").isNotNull(), F.struct("lat", "lng"))
        fields = [F.col("kind").alias("type"), F.col("id"), point.alias("point")]
        if "geometry" in found.columns:
            fields.append(F.col("geometry"))
        positions = F.array(F.struct(*fields))
    # to_json() treats the nulls of all levels alike, so the positions are written apart and set in as they are
    fields = F.to_json(
        F.struct(F.col("kind").alias("type"), "id", "title", "participation_open", F.col("short_name").alias("source"), "color"), {"ignoreNullFields": "false"}
    )
    document = F.concat(F.expr("left(fields, length(fields) - 1)"), F.lit(',"positions":'), F.to_json("written"), F.lit("}"))
    dressed = found.join(sources, "source_id", "left").withColumns({"fields": fields, "written": positions})
    return dressed.select(*keep, document.alias("document"))


def positions_of_news(mentions: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(news_item_id, positions): streets, then numbers, then places of a news item that have a point or a geometry.

    mentions: news_item_id, kind, target_id; gazetteer: kind, target_id, point, geometry. Mentions are stored and counted first: lists are
    made by sorting all that a task gets, so tasks get a bounded number of them.
    """
    mentions = shared_table(mentions.select("news_item_id", "kind", "target_id"))
    order = F.array_position(F.array(F.lit("street"), F.lit("street_number"), F.lit("place")), F.col("kind"))
    placed = mentions.join(gazetteer, ["kind", "target_id"]).where("point is not null or geometry is not null")
    entry = F.struct(order.alias("o"), F.col("target_id"), F.col("kind"), F.col("point"), F.col("geometry"))
    placed = dealt(placed.select("news_item_id", entry.alias("entry")), mentions.count(), "news_item_id")
    grouped = placed.groupBy("news_item_id").agg(F.array_sort(F.collect_list("entry"), lambda a, b: F.when(a.o < b.o, -1).when(a.o > b.o, 1).when(a.target_id < b.target_id, -1).otherwise((a.target_id > b.target_id).cast("int"))).alias("e"))
    return grouped.select("news_item_id", F.transform("e", lambda x: F.struct(x.kind.alias("type"), x.target_id.alias("id"), x.point.alias("point"), x.geometry.alias("geometry"))).alias("positions"))


def geometries_of_positions() -> tuple[Column, Column]:
    """(geometries, geo_points) of positions: of streets and places, and of all three; null if none."""
    shapes = F.transform(F.filter("positions", lambda x: (x.type != "street_number") & x.geometry.isNotNull()), lambda x: x.geometry)
    points = F.transform(F.filter("positions", lambda x: x.point.isNotNull()), lambda x: x.point)
    return F.when(F.size(shapes) > 0, shapes).alias("geometries"), F.when(F.size(points) > 0, points).alias("geo_points")


def cached_geometries(mentions: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(news_item_id, geometries, geo_points) for all news items at once, as geometries_of_positions() has them."""
    return positions_of_news(mentions, gazetteer).select("news_item_id", *geometries_of_positions())


def refresh_geometries(
    cached: DataFrame, mentions: DataFrame, gazetteer: DataFrame, changed_news: DataFrame | None = None, changed_places: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(changes, cached after them): cached_geometries() kept up by what changed alone.

    changed_news (news_item_id): news items whose mentions came, went or changed; changed_places (kind, target_id):
    rows of the gazetteer that did. mentions and gazetteer are those after the change. Items with a changed
    mention, or a mention of a changed row, are made anew; of the others neither mentions nor geometries are touched. changes
    has the items made anew, with gone = true for those that have no position left, as SnapshotStore.change() takes them.
    """
    touched = cached.select("news_item_id").limit(0)
    if changed_news is not None:
        touched = touched.unionByName(changed_news.select("news_item_id"))
    if changed_places is not None:
        touched = touched.unionByName(mentions.join(changed_places.select("kind", "target_id").distinct(), ["kind", "target_id"], "left_semi").select("news_item_id"))
    touched = shared_table(touched.distinct())
    their = mentions.join(touched, "news_item_id", "left_semi")
    wanted = gazetteer.join(their.select("kind", "target_id").distinct(), ["kind", "target_id"], "left_semi")
    new = cached_geometries(their, wanted)
    changes = shared_table(touched.join(new.withColumn("__there", F.lit(True)), "news_item_id", "left").withColumn("gone", F.col("__there").isNull()).drop("__there"))
    after = cached.join(touched, "news_item_id", "left_anti").unionByName(changes.where("not gone").drop("gone").select(cached.columns))
    return changes, after


def collapse_single_news(details: DataFrame) -> DataFrame:
    """details (kind, target_id, news_item_id): what has exactly one news item is shown as that item."""
    n = F.count("news_item_id").over(Window.partitionBy("kind", "target_id"))
    alone = F.col("__n") == 1
    return details.withColumn("__n", n).select(
        "kind", "target_id", "news_item_id", F.when(alone, F.lit("news_item")).otherwise(F.col("kind")).alias("shown_kind"), F.when(alone, F.col("news_item_id")).otherwise(F.col("target_id")).alias("shown_id")
    )


def feed_rows(found: DataFrame, base_url: str) -> DataFrame:
    """Feed entries (query_id, entry_id, title, updated, content) of items with title, description and inserted_at."""
    link = F.concat(F.lit(base_url), detail_link(F.struct("lng", "lat"), F.col("id"), F.col("kind")))
    return found.select("query_id", link.alias("entry_id"), "title", F.date_format("inserted_at", "dd.MM.yyyy").alias("updated"), text_to_html(F.col("description")).alias("content"))


def by_ids(table: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows of many ids; for a few, filter with isin()."""
    return table.join(ids.select(column).distinct(), column, "left_semi")


def by_natural_key(table: DataFrame, **key) -> DataFrame:
    """Rows of one natural key, such as short_name or source_id with external_id."""
    for c, v in key.items():
        table = table.where(F.col(c) == F.lit(v))
    return table
