"""A stored index of street names: postings by key, changed by upserts, read by the keys of the searches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.functions.text import german_tokens
from civicspark.operators.search import SHOWN, asked_with_rarest_keys, name_index_keys, ranked_matches
from civicspark.operators.versions import SnapshotStore
from civicspark.storage import shared_table

NAMED = ("id", "name", "district", "street_number_count")


class StreetIndex:
    """Names with their words, and postings (key, id), both stored in versions.

    Words are German stems without stop words; another function of a name may be given, and must be given
    again whenever the index is opened. Postings are rows by buckets of keys, sorted by key, so a key that nearly all names
    share is many rows and no long list. One writer at a time; readers see the names and postings of a finished upsert or, between
    its two commits, postings that are ahead of the names, whose matches are tested all the same.
    """

    def __init__(self, spark: SparkSession, path: str, tokens: Callable[[Column], Column] = german_tokens, buckets: int | None = None):
        self.tokens = tokens
        self.names = SnapshotStore(spark, f"{path.rstrip('/')}/names", ["id"], buckets)
        self.postings = SnapshotStore(spark, f"{path.rstrip('/')}/postings", ["key", "id"], buckets, by=["key"])

    def _with_words(self, names: DataFrame) -> DataFrame:
        return names.select(*NAMED, F.lower("name").alias("__name"), self.tokens(F.col("name")).alias("__tokens"))

    @staticmethod
    def _keys(names: DataFrame) -> DataFrame:
        return names.select(F.explode(name_index_keys(F.col("__name"), F.col("__tokens"))).alias("key"), "id").distinct()

    def upsert(self, names: DataFrame, gone: DataFrame | None = None) -> None:
        """Add names (id, name, district, street_number_count), replace those of known ids, and take away the ids of gone.

        An index without names is made. Later, the words of these names alone are made, and only buckets of their keys and ids
        written. An id that stands in both is replaced; ids are unique and not null.
        """
        new = shared_table(self._with_words(names))
        if not self.names.versions():
            self.postings.store(self._keys(new))
            self.names.store(new)
            return
        touched = new.select("id") if gone is None else new.select("id").unionByName(gone.select("id")).distinct()
        old = self.names.read_for(touched).join(touched, "id", "left_semi")
        postings = self._keys(old).withColumn("gone", F.lit(True)).unionByName(self._keys(new).withColumn("gone", F.lit(False)))
        changed = postings.groupBy("key", "id").agg(F.bool_and("gone").alias("gone"), F.count("*").alias("n"))
        self.postings.change(shared_table(changed.where("n = 1").drop("n")))  # a key before and after stays as it is
        rows = new.withColumn("gone", F.lit(False))
        if gone is not None:
            kinds = dict(new.dtypes)
            empty = [F.lit(None).cast(kinds[c]).alias(c) for c in new.columns if c != "id"]
            rows = rows.unionByName(gone.select("id", *empty, F.lit(True).alias("gone")))
        self.names.change(rows)

    def search(self, searches: DataFrame, shown: int = SHOWN) -> DataFrame:
        """search_contains() over the index: only buckets with a key of a search and those of the names it leads to are read.

        Of the keys of a search, the one of fewest names leads to them."""
        asked = shared_table(asked_with_rarest_keys(searches, self.tokens, self.postings.read_for).withColumnRenamed("__k", "key"))
        postings = self.postings.read_for(asked.select("key").distinct())
        found = shared_table(asked.join(postings, "key").drop("key").distinct())
        names = self.names.read_for(found.select("id").distinct())
        return ranked_matches(found.join(names, "id"), shown)
