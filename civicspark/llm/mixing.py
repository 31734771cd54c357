"""Mixing sources to target weights by pivotal dependent rounding on a reduction tree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.llm.common import join_back, numbered, salt, salts, shared_table, text_or_empty, with_salts

#: Documents that one block of the reduction tree rounds in sequence.
BLOCK = 64
#: Probabilities closer than this to 0 or 1 are integral.
TINY = 1e-12


def _ranked(rows: DataFrame, column: str) -> DataFrame:
    """rows with __place, their rank from 0 by a column of distinct values, null last.

    Ranges of the column are sorted side by side; only the ranges' counts, one row each, meet in one window.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, F.col(column).asc_nulls_last()).sortWithinPartitions(F.col(column).asc_nulls_last())
    dealt = shared_table(dealt.select("*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__at")))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    return dealt.join(firsts, "__range").withColumn("__place", F.col("__first") + F.col("__at")).drop("__range", "__at", "__first")


def source_targets(sizes: DataFrame, source: str, size: str, weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target, salts) from one row per document, with a column salt.

    The sources in code point order, null last, weigh the given weights, repeating, and share `share` of
    all sizes; a target stops at `cap` times its source's size and the excess is shared again by weight.
    A target is the lesser of cap and level times weight. The level rises from round to round, as sources
    that it fills give their excess to the others, until it fills no more; a round is one sum over the
    sources, of which there may be any number. salts is the set of the documents' salts.
    """
    per_source = sizes.groupBy(source).agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("source_size"), salts("salt").alias("salts"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("__place"), F.lit(len(weights))) + 1).cast("int"))
    t = _ranked(per_source, source).withColumn("__w", weight).withColumn("__cap", F.lit(float(cap)) * F.col("source_size"))
    t = shared_table(t.drop("__place"))
    level = 0.0
    while True:  # whole numbers are summed, so the order of the rows does not matter
        full = F.col("__cap") <= F.lit(level) * F.col("__w")
        r = t.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("__cap"))).alias("full"), F.sum(F.when(~full, F.col("__w"))).alias("open")).first()
        above = (share * (r["all"] or 0) - (r["full"] or 0.0)) / r["open"] if r["open"] else math.inf
        if above <= level or math.isinf(above):
            level = max(level, above)
            break
        level = above
    target = F.least("__cap", F.lit(level) * F.col("__w"))
    return t.select(source, "source_size", target.alias("target"), "salts")


def _uniform(*cols: Column) -> Column:
    """A number from 0 to 1 that depends on nothing but the values."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _pivot(seed: int):
    """One step of pivotal rounding: the carried document and the next one move mass until one is integral."""

    def step(acc: Column, x: Column) -> Column:
        c, out = acc.carry, acc.out
        total = c.p + x.p
        u = _uniform(F.lit(seed), c.id, c.size, x.id, x.size)

        def decided(d: Column, take: int) -> Column:
            return F.struct(d.id.alias("id"), d["size"].alias("size"), F.lit(take).alias("take"))

        def carrying(d: Column, p: Column) -> Column:
            return F.struct(d.id.alias("id"), d["size"].alias("size"), p.alias("p"))

        def state(carry: Column, *more: Column) -> Column:
            return F.struct(carry.alias("carry"), F.concat(out, F.array(*more)).alias("out"))

        nobody = F.lit(None).cast("void")
        under = F.when(u * total < x.p, state(carrying(x, total), decided(c, 0))).otherwise(state(carrying(c, total), decided(x, 0)))
        exact = F.when(u < x.p, F.struct(nobody.alias("carry"), F.concat(out, F.array(decided(x, 1), decided(c, 0))).alias("out"))).otherwise(
            F.struct(nobody.alias("carry"), F.concat(out, F.array(decided(c, 1), decided(x, 0))).alias("out"))
        )
        above = F.when(u * (2 - total) < 1 - x.p, state(carrying(x, total - 1), decided(c, 1))).otherwise(
            state(carrying(c, total - 1), decided(x, 1))
        )
        return (
            F.when(c.isNull(), F.struct(carrying(x, x.p).alias("carry"), out.alias("out")))
            .when(F.abs(total - 1) < TINY, exact)
            .when(total < 1, under)
            .otherwise(above)
        )

    return step


def pivotal_round(rows: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(group, id, size, take): take is 0 or 1 with expectation p, and the takes of a group add up to within one of the sum of its p.

    rows: (group, id, size, p) with p from 0 to under 1, no two rows with equal group, id and size. Each
    block holds documents of similar size in size order, so the sizes taken balance as the counts do. A
    block leaves one undecided document at most; those of the blocks meet on the next level of the tree
    until a group has one, which its own draw settles. Draws depend on ids and sizes only.
    """
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    doc = f"struct<id:{kind['id']},size:bigint,p:double>"
    zero = F.expr(f"named_struct('carry', cast(null as {doc}), 'out', cast(array() as array<struct<id:{kind['id']},size:bigint,take:int>>))")
    sure = F.col("p") < TINY
    done = rows.where(sure).select("group", "id", "size", F.lit(0).alias("take"))
    rows = rows.withColumn("salt", salt("id"))
    left, level = rows.where(~sure).withColumn("class", F.floor(4 * F.log2(F.col("size") + F.lit(1))).cast("int")), 0
    while True:
        counts = left.groupBy("group", "class").agg(F.ceil(F.count("*") / block).alias("blocks"), salts("salt").alias("salts"))
        if level and counts.where("blocks > 1").isEmpty() and left.groupBy("group").count().where("count > 1").isEmpty():
            break
        dealt = join_back(left, with_salts(counts), ["group", "class", "salt"])
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + level), "id", "size"), F.col("blocks")))
        members = F.array_sort(F.collect_list(F.struct("size", F.xxhash64(F.lit(seed), "id").alias("h"), "id", "p")))
        folded = dealt.groupBy("group", "class", "block").agg(members.alias("members"))
        folded = folded.select("group", F.aggregate("members", zero, _pivot(seed)).alias("r")).select("group", "r.carry", "r.out")
        folded = shared_table(folded)
        done = done.unionByName(folded.select("group", F.inline("out")))
        left = folded.where("carry is not null").select("group", "carry.id", "carry.size", "carry.p", F.lit(0).alias("class")).withColumn("salt", salt("id"))
        level += 1
    last = left.select("group", "id", "size", (_uniform(F.lit(seed), F.col("id"), F.col("size")) < F.col("p")).cast("int").alias("take"))
    return done.unionByName(last)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 0,
) -> DataFrame:
    """How often each document goes into the mix: (id_col, __th, size, source_size, target, copies, taken).

    A document's size is its number of words; each source's documents are repeated target / source_size
    times in the mean: the whole part for all, the rest by pivotal rounding. One row per input row;
    __th is the hash of the text, which with the id names the row. Null and empty texts have size 0 and
    are not taken; a null source is the last source; a null id is an id. Rows with equal source, id and
    size are taken alike. A source of size 0 has target 0. An empty table gives an empty result. Only
    the three named columns are read. Reruns agree, whatever the partitions.
    """
    text = text_or_empty(text_col)
    base = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("group"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        F.xxhash64(text).alias("__th"),
    )
    base = shared_table(base).withColumn("salt", salt("id"))
    goals = shared_table(with_salts(source_targets(base, "group", "size", weights, share, cap)))
    often = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    one = join_back(base.where("size > 0").select("group", "id", "size", "salt").distinct(), goals, ["group", "salt"])
    rounded = pivotal_round(one.select("group", "id", "size", (often - F.floor(often)).alias("p")), seed)
    whole = join_back(base, goals, ["group", "salt"]).withColumn("whole", F.floor(often))
    out = join_back(whole, rounded, ["group", "id", "size"])
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("take", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.withColumn("copies", copies).select(
        F.col("id").alias(id_col), "__th", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The mix itself: every row of docs, with all its columns, whatever these are called, as often as mix() takes it."""
    rows, (key, text, source) = numbered(docs, id_col, text_col, source_col)
    often = mix(rows, key, text, source, **kw).where("copies > 0")
    often = often.groupBy(F.col(key).alias("__id"), "__th").agg(F.max("copies").alias("__copies"))
    keyed = rows.withColumns({"__id": F.col(key), "__th": F.xxhash64(text_or_empty(text))})
    taken = join_back(keyed, often, ["__id", "__th"], "inner")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(rows.columns).toDF(*docs.columns)
