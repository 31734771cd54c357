"""Tables of the engine's own shapes, derived from the TPC-H-like tables by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.storage import shared_table

AS_OF = "2001-08-01 00:00:00"
STATES = ("intended", "in_preparation", "in_planning", "under_construction", "active", "finished")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def lng(k: str) -> Column:
    return F.lit(13.08) + (F.col(k) * 7919 % 10007).cast("double") / F.lit(10007.0) * F.lit(0.68)


def lat(k: str) -> Column:
    return F.lit(52.33) + (F.col(k) * 104729 % 10009).cast("double") / F.lit(10009.0) * F.lit(0.35)


def geo_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    state = F.element_at(F.array(*[F.lit(s) for s in STATES], F.lit(None).cast("string")), (key % 7 + 1).cast("int"))
    end = F.when(key % 3 != 0, F.col("o_orderdate") + F.make_dt_interval((key % 90).cast("int")))
    return o.select(
        key.alias("id"),
        F.lit("geo_item").alias("kind"),
        F.lit(0).alias("kind_order"),
        (key % 25).alias("source_id"),
        key.cast("string").alias("external_id"),
        F.col("o_orderpriority").alias("title"),
        state.alias("state"),
        F.col("o_orderdate").alias("date_start"),
        end.alias("date_end"),
        F.lit(None).cast("timestamp_ntz").alias("date_updated"),
        (F.col("o_orderstatus") == "O").alias("participation_open"),
        (key % 17 == 0).alias("hidden"),
        F.col("o_orderdate").alias("inserted_at"),
        lng("o_orderkey").alias("lng"),
        lat("o_orderkey").alias("lat"),
    )


def query_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), lng("s_suppkey").alias("q_lng"), lat("s_suppkey").alias("q_lat"))


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(key.alias("sub_id"), key.alias("user_id"), (500 + 250 * (key % 7)).cast("int").alias("radius_m"), lng("c_custkey").alias("lng"), lat("c_custkey").alias("lat"))


def street_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    letter = F.when(F.col("l_returnflag") == "R", "A").otherwise("")
    return li.select(
        F.col("l_orderkey").alias("geo_street_id"),
        F.concat(F.lit("Street "), F.col("l_orderkey").cast("string")).alias("name"),
        F.col("l_linestatus").alias("district"),
        F.concat(F.lit("City "), F.col("l_returnflag")).alias("city"),
        F.concat(F.col("l_linenumber").cast("string"), letter).alias("number"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").alias("seq"),
        (lng("l_orderkey") + F.col("l_linenumber") * F.lit(0.0007)).alias("lng"),
        (lat("l_orderkey") + F.col("l_linenumber") * F.lit(0.0007)).alias("lat"),
    )


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, n): distinct words of the benchmark passages, numbered by a hash of theirs, which needs no order over all.

    A stored table, as a gazetteer is: what makes the words is neither run for each use nor asked of the other side of a join.
    """
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("name"))
    words = words.where(F.col("name").rlike(r"^\p{L}{4,}$")).distinct()
    return shared_table(words.withColumn("n", F.conv(F.substring(F.md5(F.col("name").cast("binary")), 1, 12), 16, 10).cast("long")))


def _districted(words: DataFrame, again: Column, shift: int) -> DataFrame:
    """(id, name, district): each word in a district of its own, and those of `again` in a second one too."""
    district = lambda k: F.concat(F.lit("src"), (k % 20).cast("string")).alias("district")
    return words.select(F.col("n").alias("id"), "name", district(F.col("n")), "n").unionByName(
        words.where(again).select((F.col("n") + 1).alias("id"), "name", district(F.col("n") + shift), "n")
    )


def _typed(places: DataFrame) -> DataFrame:
    kind = F.element_at(F.array(F.lit("Park"), F.lit("School"), F.lit("LOR")), (F.col("n") % 3 + 1).cast("int"))
    return places.select("id", "name", "district", kind.alias("type"))


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as places: every third name in a second district too."""
    return _typed(_districted(_words(spark, sf_dir), F.col("n") % 3 == 0, 7))


def tag_gazetteer(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(streets, numbers, places): words as streets, as places, and as both; streets have up to fifteen numbers, some with a letter."""
    words = _words(spark, sf_dir)
    streets = _districted(words.where("n % 2 = 0"), F.col("n") % 10 == 0, 3).drop("n")
    places = _typed(_districted(words.where("n % 4 > 0"), F.col("n") % 12 == 3, 7))
    numbers = streets.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(15), (2 + F.col("id") % 14).cast("int")))))
    number = F.concat(F.col("k").cast("string"), F.when(F.col("k") % 3 == 0, "A").otherwise(""))
    return streets, numbers.select((F.col("id") * 16 + F.col("k")).alias("id"), F.col("id").alias("geo_street_id"), number.alias("number")), places


def street_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_name").alias("name"), F.col("p_brand").alias("district")).agg(F.count("*").alias("street_number_count"))


#: The same tables for DuckDB, as common table expressions by name.
ORACLE = {
    "geo_items": """geo_items as (
    select o_orderkey as id, 'geo_item' as kind, 0 as kind_order, o_orderkey % 25 as source_id, cast(o_orderkey as varchar) as external_id, o_orderpriority as title,
           (['intended', 'in_preparation', 'in_planning', 'under_construction', 'active', 'finished', null])[o_orderkey % 7 + 1] as state,
           o_orderdate as date_start, case when o_orderkey % 3 <> 0 then o_orderdate + to_days(cast(o_orderkey % 90 as integer)) end as date_end,
           o_orderstatus = 'O' as participation_open, o_orderkey % 17 = 0 as hidden, o_orderdate as inserted_at,
           cast(13.08 as double) + cast(o_orderkey * 7919 % 10007 as double) / cast(10007 as double) * cast(0.68 as double) as lng,
           cast(52.33 as double) + cast(o_orderkey * 104729 % 10009 as double) / cast(10009 as double) * cast(0.35 as double) as lat
    from orders)""",
    "query_points": """query_points as (
    select s_suppkey as query_id,
           cast(13.08 as double) + cast(s_suppkey * 7919 % 10007 as double) / cast(10007 as double) * cast(0.68 as double) as q_lng,
           cast(52.33 as double) + cast(s_suppkey * 104729 % 10009 as double) / cast(10009 as double) * cast(0.35 as double) as q_lat
    from supplier)""",
    "subscriptions": """subscriptions as (
    select c_custkey as sub_id, c_custkey as user_id, 500 + 250 * (c_custkey % 7) as radius_m,
           cast(13.08 as double) + cast(c_custkey * 7919 % 10007 as double) / cast(10007 as double) * cast(0.68 as double) as lng,
           cast(52.33 as double) + cast(c_custkey * 104729 % 10009 as double) / cast(10009 as double) * cast(0.35 as double) as lat
    from customer)""",
    "street_numbers": """street_numbers as (
    select l_orderkey as geo_street_id, 'Street ' || l_orderkey as name, l_linestatus as district, 'City ' || l_returnflag as city,
           l_linenumber || case when l_returnflag = 'R' then 'A' else '' end as number, l_linenumber as n,
           (l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as seq,
           cast(13.08 as double) + cast(l_orderkey * 7919 % 10007 as double) / cast(10007 as double) * cast(0.68 as double) + l_linenumber * cast(0.0007 as double) as lng,
           cast(52.33 as double) + cast(l_orderkey * 104729 % 10009 as double) / cast(10009 as double) * cast(0.35 as double) + l_linenumber * cast(0.0007 as double) as lat
    from lineitem)""",
    "gazetteer": """words as (
    select distinct unnest(string_split(text, ' ')) as name from benchmark
), numbered as (
    select name, cast('0x' || md5(name)[1:12] as bigint) as n from words where regexp_full_match(name, '\\p{L}{4,}')
), gazetteer as (
    select n as id, name, 'src' || (n % 20) as district, (['Park', 'School', 'LOR'])[n % 3 + 1] as type from numbered
    union all select n + 1, name, 'src' || ((n + 7) % 20), (['Park', 'School', 'LOR'])[n % 3 + 1] from numbered where n % 3 = 0)""",
    "street_names": """street_names as (
    select p_name as name, p_brand as district, count(*) as street_number_count from part group by p_name, p_brand)""",
}

#: Metres between (lng1, lat1) and (lng2, lat2) as a DuckDB expression.
HAVERSINE = (
    "(2 * 6371008.8 * atan2(sqrt({a}), sqrt(1 - ({a}))))".replace(
        "{a}",
        "sin(radians({lat2} - {lat1}) / 2) * sin(radians({lat2} - {lat1}) / 2)"
        " + sin(radians({lng2} - {lng1}) / 2) * sin(radians({lng2} - {lng1}) / 2) * cos(radians({lat1})) * cos(radians({lat2}))",
    )
)


def haversine_sql(lng1: str, lat1: str, lng2: str, lat2: str) -> str:
    return HAVERSINE.format(lng1=lng1, lat1=lat1, lng2=lng2, lat2=lat2)


def with_tables(*names: str) -> str:
    return "with " + ", ".join(ORACLE[n] for n in names)
