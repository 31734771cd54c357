"""Merkle manifest of a dataset: a tree of hashes per group and one over the groups, built by sibling-shift self-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.llm.common import shared_table

#: Consecutive nodes that make one parent.
ARITY = 8


def field(c: Column) -> Column:
    """A value as a leaf hashes it: `-` for null, else its UTF-8 byte count, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def numbered_in_groups(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with `idx`, their place from 0 within the group, and `n`, the group's size.

    Ranges of (group, order) are sorted side by side, so a large group is many ranges; a window orders the
    rows of one group in one range, and only the counts of the ranges, a few rows each, meet per group.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, group, *order).sortWithinPartitions(group, *order)
    # rows of a range come in order, so their number in the range is their order
    dealt = shared_table(dealt.select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")))
    counts = dealt.groupBy(group, "range").agg(F.count("*").alias("here"), F.min("at").alias("first"))
    before = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        group, "range", (F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("here").over(Window.partitionBy(group)).alias("n")
    )
    return dealt.join(counts, [group, "range"]).withColumn("idx", F.col("at") + F.col("shift")).drop("range", "at", "shift")


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes (group, n, idx, hash, ...) with `before` and `after`: the hashes of the run's other nodes, left to right.

    Each node computes the indices of its run's slots (XOR with 1 for pairs, slot offsets for longer runs)
    and meets the nodes there in an equality join.
    """
    slot = F.pmod("idx", F.lit(arity))
    if arity == 2:
        shifted = F.array(F.col("idx").bitwiseXOR(F.lit(1)))
    else:
        shifted = F.transform(F.sequence(F.lit(1), F.lit(arity - 1)), lambda k: F.col("idx") - slot + F.pmod(slot + k, F.lit(arity)))
    asked = nodes.where("n > 1").select("group", "idx", F.explode(F.filter(shifted, lambda i: i < F.col("n"))).alias("sibling"))
    there = nodes.select("group", F.col("idx").alias("sibling"), F.unhex("hash").alias("other"))
    met = asked.join(there, ["group", "sibling"]).groupBy("group", "idx").agg(F.array_sort(F.collect_list(F.struct("sibling", "other"))).alias("others"))

    def side(keep) -> Column:
        chosen = F.filter(F.coalesce("others", F.array()), keep)
        return F.array_join(F.transform(chosen, lambda s: F.lower(F.hex(s.other))), "")

    return nodes.join(met, ["group", "idx"], "left").select(
        *nodes.columns, side(lambda s: s.sibling < F.col("idx")).alias("before"), side(lambda s: s.sibling > F.col("idx")).alias("after")
    )


def climb(leaves: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """The levels of all groups' trees from the leaves up: each (group, n, idx, hash, before, after).

    leaves: (group, n, idx, hash) and columns that stay on the first level. n is the group's number of nodes
    on the level. A group with one node is at its top and has no parent. Levels shrink by the arity, each a table.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, nodes = [], leaves
    while True:
        level = shared_table(_with_siblings(nodes, arity))
        levels.append(level)
        if most <= 1:
            return levels
        most = -(-most // arity)
        # the node in slot zero stands for its run
        nodes = level.where((F.col("n") > 1) & (F.pmod("idx", F.lit(arity)) == 0)).select(
            "group",
            F.ceil(F.col("n") / arity).alias("n"),
            F.floor(F.col("idx") / arity).alias("idx"),
            F.sha2(F.concat("hash", "after"), 256).alias("hash"),
        )


def descend(levels: list[DataFrame], tops: DataFrame, arity: int = ARITY) -> DataFrame:
    """The leaves with `path`, the siblings (before, after) of each ancestor from the leaf up, and what tops holds.

    tops: (group, path, ...), the path from the group's top onwards. Paths go down level by level, parents to children.
    """
    known = None
    more = [c for c in tops.columns if c not in ("group", "path")]
    for at, level in reversed(list(enumerate(levels))):
        keep = level.columns if at == 0 else ["group", "idx", "before", "after"]
        here = level.where("n = 1").select(*keep).join(tops, "group").select(*[c for c in keep if c not in ("before", "after")], "path", *more)
        if known is not None:
            own = level.where("n > 1").select(*keep, F.floor(F.col("idx") / arity).alias("parent"))
            up = known.withColumnRenamed("idx", "parent")
            step = F.concat(F.array(F.struct("before", "after")), "path").alias("path")
            here = here.unionByName(own.join(up, ["group", "parent"]).select(*[c for c in keep if c not in ("before", "after")], step, *more))
        known = here
    return known


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s.before, h, s.after), 256))


def manifest(
    docs: DataFrame,
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    group_col: str = "lang",
    tampered: dict[str, Column] | None = None,
    arity: int = ARITY,
) -> DataFrame:
    """(id_col, leaf, subroot, root, path, tampered_leaf): a leaf per row of docs, with its path to the root.

    Leaves of a group ascend by id, equal ids by leaf; while a group has more than one node, each arity
    consecutive ones become the hash of their hashes, the last run being shorter. What remains is the
    group's subroot; the subroots, ordered by group, null first, then by UTF-8 bytes, give the root likewise.
    path is an array of (before, after), the hashes of the siblings to the left and right from the leaf
    up, joined. tampered replaces columns by expressions; tampered_leaf is the leaf of the row so
    changed, null where no expression is given.

    A null id is a leaf like any other and sorts first; a null group is a group; repeated rows are leaves
    each. An empty table gives an empty result. Only the named columns are read, so others cannot clash.
    Texts are hashed where they are read; what moves are hashes. Groups may be of any size and number.
    """
    given = {c: F.col(c) for c in columns}
    changed = F.lit(None).cast("string") if tampered is None else leaf_hash(*(given | tampered).values())
    # an order of strings with null first: no value begins with less than "="
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), group.alias("group"), leaf_hash(*given.values()).alias("hash"), changed.alias("changed"))
    levels = climb(numbered_in_groups(rows, "group", ["id", "hash"]), arity)

    subroots = None
    for level in levels:
        top = level.where("n = 1").select(F.lit("").alias("group"), F.col("group").alias("of"), "hash")
        subroots = top if subroots is None else subroots.unionByName(top)
    upper = climb(numbered_in_groups(subroots, "group", ["of"]), arity)
    root = None
    for level in upper:
        top = level.where("n = 1").select("group", F.col("hash").alias("root"), F.array().cast("array<struct<before:string,after:string>>").alias("path"))
        root = top if root is None else root.unionByName(top)
    tops = descend(upper, root, arity).select(F.col("of").alias("group"), F.col("hash").alias("subroot"), "root", "path")
    return descend(levels, shared_table(tops), arity).select(
        F.col("id").alias(id_col), F.col("hash").alias("leaf"), "subroot", "root", "path", F.col("changed").alias("tampered_leaf")
    )
