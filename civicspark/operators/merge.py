"""Upserts as functions from a snapshot and a batch to the next snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.functions.geo import haversine_m

#: States an item may be in.
STATES = ("intended", "in_preparation", "in_planning", "under_construction", "active", "finished")


def last_present(batch: DataFrame, keys: list[str], seq: str, columns: list[str]) -> DataFrame:
    """One row per key: for every column the value of the last row that has it, and __has_<column>.

    batch may have present array<string>, the columns that a row sets; without it a row sets all. Nulls that
    are set count. The last row is that with the largest seq; partial maxima go before the shuffle.
    """
    sets = lambda c: F.array_contains("present", c) if "present" in batch.columns else F.lit(True)
    values = [F.max_by(F.struct(F.col(c).alias("v")), F.when(sets(c), F.col(seq))).alias(c) for c in columns]
    grouped = batch.groupBy(*keys).agg(*values)
    return grouped.select(*keys, *[F.col(c)["v"].alias(c) for c in columns], *[F.col(c).isNotNull().alias(f"__has_{c}") for c in columns])


def merge_snapshot(old: DataFrame, batch: DataFrame, keys: list[str], as_of: Column, seq: str = "seq", replace: bool = False) -> DataFrame:
    """The snapshot after a batch: rows of known keys change, others are added.

    A partial merge changes only the columns that batch rows set, last write wins; replace sets all. The
    id and inserted_at of known rows stay, updated_at moves only where something changed. Rows with a null
    key are rejected by validate(), not here, and match nothing.
    """
    own = [c for c in old.columns if c not in (*keys, "inserted_at", "updated_at", "id")]
    given = [c for c in own if c in batch.columns]
    if replace and "present" in batch.columns:
        batch = batch.drop("present")
    new = last_present(batch, keys, seq, given)
    new = new.select([F.col(c).alias(f"__n_{c}" if not c.startswith("__has_") else c) for c in new.columns])
    on = [old[k] == new[f"__n_{k}"] for k in keys]
    both = old.withColumn("__old", F.lit(True)).join(new.withColumn("__new", F.lit(True)), on, "full_outer")

    def value(c: str) -> Column:
        if c not in given:
            return F.when(F.col("__new") & F.lit(replace), F.lit(None)).otherwise(F.col(c))
        return F.when(F.coalesce(F.col(f"__has_{c}"), F.lit(False)) | (F.coalesce(F.col("__new"), F.lit(False)) & F.lit(replace)), F.col(f"__n_{c}")).otherwise(F.col(c))

    changed = F.lit(False)
    for c in own:
        changed = changed | ~value(c).eqNullSafe(F.col(c))
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.coalesce(F.col(c), F.col(f"__n_{c}")).alias(c))
        elif c == "inserted_at":
            out.append(F.coalesce(F.col(c), as_of).alias(c))
        elif c == "updated_at":
            out.append(F.when(F.col("__old").isNull() | changed, as_of).otherwise(F.col(c)).alias(c))
        elif c == "id":
            natural = F.xxhash64(*[F.coalesce(F.col(k), F.col(f"__n_{k}")) for k in keys])
            out.append(F.coalesce(F.col(c), natural.cast(old.schema[c].dataType)).alias(c))
        else:
            out.append(value(c).alias(c))
    return both.select(out)


def validate(items: DataFrame, required: tuple = ("source_id", "external_id", "title")) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): rejected rows have reason; a state is one of STATES or null. One bad row stops no batch."""
    reason = F.lit(None).cast("string")
    for c in required:
        reason = F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(f"{c} is missing")).otherwise(reason)
    if "state" in items.columns:
        reason = F.coalesce(reason, F.when(~F.coalesce(F.col("state").isin(*STATES), F.lit(True)), F.lit("state is unknown")))
    judged = items.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def replace_mentions(old: DataFrame, touched: DataFrame, new: DataFrame, key: str = "news_item_id") -> DataFrame:
    """Associations after an update: those of touched items go, the new ones come."""
    return old.join(touched.select(key).distinct(), key, "left_anti").unionByName(new)


def apply_subscription_events(subscriptions: DataFrame, events: DataFrame, metres: float = 100.0, default_radius: int = 2000) -> DataFrame:
    """Subscriptions after events (seq, op, user_id, lng, lat, radius_m), which happen one after the other in the order of seq.

    An event is about the user's subscription within `metres` of its point, the one with the smallest id of
    several. subscribe adds one where there is none (default_radius without a radius) and else sets its
    radius; update sets the radius of one that is there; unsubscribe takes it away. What an event adds or
    takes, those after it see. An event without a radius changes none; without a user, point or known op nothing.
    Only users with events are folded, each over its own subscriptions; no user sees another's.
    """
    columns = subscriptions.columns
    kind = {f.name: f.dataType for f in subscriptions.schema}
    entry = F.struct(*columns)
    happened = events.where("user_id is not null and lng is not null and lat is not null")
    happened = happened.select("user_id", F.struct("seq", "op", "lng", "lat", F.col("radius_m").cast(kind["radius_m"]).alias("radius_m")).alias("e"))
    queues = happened.groupBy("user_id").agg(F.array_sort(F.collect_list("e")).alias("queue"))
    touched = subscriptions.join(queues.select("user_id"), "user_id", "left_semi").groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("own"))
    shape = f"array<struct<{','.join(f'{c}:{kind[c].simpleString()}' for c in columns)}>>"

    def with_radius(sub: Column, radius: Column) -> Column:
        return F.struct(*[(radius if c == "radius_m" else sub[c]).alias(c) for c in columns])

    def step(own: Column, e: Column) -> Column:
        near = F.filter(own, lambda x: haversine_m(x.lng, x.lat, e.lng, e.lat) <= metres)
        hit = F.array_min(F.transform(near, lambda x: x.sub_id))
        changed = F.transform(own, lambda x: F.when((x.sub_id == hit) & e.radius_m.isNotNull(), with_radius(x, e.radius_m)).otherwise(x))
        value = {
            "sub_id": F.xxhash64(F.col("user_id"), e.seq, e.lng, e.lat), "user_id": F.col("user_id"), "lng": e.lng, "lat": e.lat,
            "radius_m": F.coalesce(e.radius_m, F.lit(default_radius)),
        }
        new = F.struct(*[value.get(c, F.lit(None)).cast(kind[c]).alias(c) for c in columns])
        return (
            F.when((e.op == "unsubscribe") & hit.isNotNull(), F.filter(own, lambda x: x.sub_id != hit))
            .when(e.op.isin("subscribe", "update") & hit.isNotNull(), changed)
            .when(e.op == "subscribe", F.concat(own, F.array(new)))
            .otherwise(own)
        )

    before = F.coalesce("own", F.array().cast(shape))
    after = queues.join(touched, "user_id", "left").select("user_id", F.aggregate("queue", before, step).cast(shape).alias("own"))
    others = subscriptions.join(queues.select("user_id"), "user_id", "left_anti")
    return others.select(columns).unionByName(after.select(F.inline("own")).select(columns))


def upsert_news(old: DataFrame, batch: DataFrame, old_mentions: DataFrame, mentions: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(items, mentions) after a batch of analysed news.

    old and batch: source_id, external_id and others; old has id, inserted_at, updated_at too. mentions: those of the
    batch by source_id and external_id, with kind and target_id. An item of the batch has its mentions replaced as a
    whole, none included, and keeps its id; items outside the batch keep theirs.
    """
    keys = ["source_id", "external_id"]
    items = merge_snapshot(old, batch, keys, as_of)
    ids = items.select(*keys, F.col("id").alias("news_item_id"))
    touched = ids.join(batch.select(*keys).distinct(), keys, "left_semi")
    new = mentions.join(touched, keys).select("news_item_id", "kind", "target_id").distinct()
    return items, replace_mentions(old_mentions.select("news_item_id", "kind", "target_id"), touched, new)
