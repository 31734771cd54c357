"""Street search: prefix, words and parts of names, ranked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions.text import search_tokens, weighted_levenshtein
from civicspark.storage import shared_table

SHOWN = 10


def _rank(found: DataFrame, *order: Column, shown: int = SHOWN) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("search").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= shown)


def search_prefix(searches: DataFrame, streets: DataFrame, shown: int = SHOWN) -> DataFrame:
    """Names that begin with a short search, whatever the case, those with most numbers first.

    The join is on the first character. Characters with a meaning in SQL patterns are taken as they are.
    """
    low = F.lower("search")
    asked = searches.where(F.length("search") > 0).withColumn("__k", F.substring(low, 1, 1))
    named = streets.withColumn("__k", F.substring(F.lower("name"), 1, 1))
    found = asked.join(named, "__k").where(F.startswith(F.lower("name"), low)).drop("__k")
    return _rank(found, F.desc("street_number_count"), F.col("name"), F.col("district"), shown=shown)


def _grams(c: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, n))


def asked_with_keys(searches: DataFrame, tokens: Callable[[Column], Column]) -> DataFrame:
    """searches of three characters or more with __low, __words, and a row for each key __k that a name it finds may have."""
    asked = searches.where(F.length("search") >= 3).withColumns({"__low": F.lower("search"), "__words": tokens(F.col("search"))})
    longest = F.array_max(F.transform("__words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keys = F.array_distinct(F.array_compact(F.array(F.concat(F.lit("c"), F.substring("__low", 1, 3)), F.concat(F.lit("w"), F.substring(longest, 1, 3)))))
    return asked.withColumn("__k", F.explode(keys))


def asked_with_rarest_keys(searches: DataFrame, tokens: Callable[[Column], Column], found_by: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As asked_with_keys(), but of the keys that every name found by its text has the one of fewest names, and of those of every name found by words too.

    found_by(keys) gives a row `key` for each name of the keys and perhaps of others. A search of a key without names finds none by it.
    """
    asked = searches.where(F.length("search") >= 3).withColumns({"__low": F.lower("search"), "__words": tokens(F.col("search"))})
    grams = F.transform(_grams(F.col("__low"), 3), lambda g: F.struct(F.lit("c").alias("by"), F.concat(F.lit("c"), g).alias("key")))
    heads = F.transform("__words", lambda w: F.struct(F.lit("w").alias("by"), F.concat(F.lit("w"), F.substring(w, 1, 3)).alias("key")))
    asked = shared_table(asked.withColumn("__keys", F.array_distinct(F.concat(grams, F.coalesce(heads, F.array())))))
    keyed = asked.select("__low", "__words", F.explode("__keys").alias("k")).select("__low", "__words", "k.*").distinct()
    keys = shared_table(keyed.select("key").distinct())
    counts = found_by(keys).join(keys, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    rarest = keyed.join(counts, "key", "left").groupBy("__low", "__words", "by").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("k"))
    rarest = rarest.where("k.n > 0").select("__low", "__words", F.col("k.key").alias("__k")).distinct()
    return asked.drop("__keys").join(rarest, ["__low", "__words"])


def name_index_keys(name: Column, words: Column) -> Column:
    """The keys that find a lower-case name with these words: its runs of three characters, and the beginnings of its words."""
    inside = F.when(F.length(name) >= 3, _grams(name, 3)).otherwise(F.array().cast("array<string>"))
    heads = F.flatten(F.transform(words, lambda t: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.substring(t, F.lit(1), n))))
    return F.array_distinct(F.concat(F.transform(inside, lambda g: F.concat(F.lit("c"), g)), F.transform(heads, lambda h: F.concat(F.lit("w"), h))))


def ranked_matches(pairs: DataFrame, shown: int) -> DataFrame:
    """Of pairs of a search (search, __low, __words) and a name (name, __name, __tokens and others) those that match, ranked."""
    part = F.contains("__name", F.col("__low"))
    every = (F.size("__words") > 0) & F.forall("__words", lambda w: F.exists("__tokens", lambda t: F.startswith(t, w)))
    found = pairs.where(part | every).drop("__k", "__low", "__words", "__name", "__tokens").distinct()
    # what more names of more numbers precede is not shown, whatever its cost
    found = found.withColumn("__first", F.rank().over(Window.partitionBy("search").orderBy(F.desc("street_number_count")))).where(F.col("__first") <= shown).drop("__first")
    found = found.withColumn("cost", weighted_levenshtein(F.lower("search"), F.lower("name")))
    return _rank(found, F.desc("street_number_count"), F.col("cost"), F.col("name"), F.col("district"), shown=shown)


def search_contains(searches: DataFrame, streets: DataFrame, shown: int = SHOWN, tokens: Callable[[Column], Column] = search_tokens) -> DataFrame:
    """Names that contain a search of three characters or more, or of whose words each search word begins one.

    Ranked by numbers, weighted edit distance and name. tokens makes the words of both sides, such as
    german_tokens() for stems without stop words; a StreetIndex has those by default. Names that contain the search share its
    first three characters with it, and names found by words the longest word's first three; these are the keys
    that find the candidates. Searches and names are told apart by their whole rows.
    """
    named = streets.withColumns({"__name": F.lower("name"), "__tokens": tokens(F.col("name"))})
    pairs = asked_with_keys(searches, tokens).join(named.withColumn("__k", F.explode(name_index_keys(F.col("__name"), F.col("__tokens")))), "__k")
    return ranked_matches(pairs, shown)


def with_duplicate_mark(found: DataFrame) -> DataFrame:
    """Whether a name stands more than once in a result, so that its district should be shown."""
    return found.withColumn("is_duplicate", F.count("*").over(Window.partitionBy("search", "name")) > 1)
