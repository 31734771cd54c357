"""Connected components of an undirected link table by alternating large-star and small-star steps.

Every step is two aggregations with partial sums and a join, so a hub with any number of links is
neither collected nor crossed; the join's skew is left to adaptive execution, which splits it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import shared_table


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has a link to another id.

    Links with a null end and links of an id to itself say nothing and are left out; repeated links
    count once; an empty table gives an empty result.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    edges = shared_table(
        links.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    )
    mark = _mark(edges)
    while mark[0]:
        # large-star: the larger neighbours of each node hang on its smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = shared_table(large)
        # small-star: the smaller neighbours of each node, and the node, hang on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = shared_table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
