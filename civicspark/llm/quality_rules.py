"""Document quality rules: statistics of single texts, and line frequency across the documents of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import SPACE_CHARS, hash128, join_back, salt, salts, shared_table, text_or_empty, with_salts, words
from civicspark.llm.line_dedup import line_key

#: A line is boilerplate of its host in more documents than LINE_DOCS, and more than LINE_SHARE of the host's or LINE_MOST.
LINE_DOCS, LINE_SHARE, LINE_MOST = 5, 0.01, 200
#: A document is depleted if fewer words stay than this, or a smaller share of its words.
LEFT_WORDS, LEFT_SHARE = 20, 0.3


def repeated_words(found: Column, n: int = 8) -> Column:
    """How many words stand in a run of n words that occurs twice or more in the same text.

    The runs are hashed and sorted with their places; equal neighbours mark the places, and the places
    in order give the union of their runs. The work is that of a sort within the row.
    """
    runs = F.transform(F.sequence(F.lit(1), F.size(found) - (n - 1)), lambda i: F.xxhash64(F.slice(found, i, n)))

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            same = F.filter(s, lambda x, k: (x.h == F.get(s, k - 1).h) | (x.h == F.get(s, k + 1).h))
            return F.sort_array(F.transform(same, lambda x: x.i))

        def union(at: Column) -> Column:
            gaps = F.transform(at, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(at, k + 1) - x, F.lit(n))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return _let(_let(placed, marked), union)

    def only_if_repeated(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered(hashes))

    return F.when(F.size(found) <= n, F.lit(0).cast("long")).otherwise(_let(runs, only_if_repeated))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for all its uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_rules(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(__id, __th, __host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), a row per input row."""
    text = F.col("__text")
    base = docs.select(F.col(id_col).alias("__id"), F.col(host_col).alias("__host"), text_or_empty(text_col).alias("__text"))
    base = base.select("*", F.xxhash64("__text").alias("__th"), words(text).alias("__words"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    base = base.withColumn("__lines", lines)
    return base.select(
        "__id",
        "__th",
        "__host",
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
    )


def boilerplate_words(docs: DataFrame, id_col: str, text_col: str, host_col: str, line_docs: int, line_share: float, line_most: int) -> DataFrame:
    """(__id, __th, removed_words, removed_lines) of rows that hold lines frequent in their host."""
    base = docs.select(F.col(id_col).alias("__id"), F.col(host_col).alias("__host"), text_or_empty(text_col).alias("__text"))
    lines = base.select("__id", "__host", F.xxhash64("__text").alias("__th"), F.posexplode(F.split("__text", "\n", -1)).alias("__pos", "__line"))
    key = line_key(F.col("__line"))
    h1, h2 = hash128(key)
    lines = lines.where(F.btrim("__line", F.lit(SPACE_CHARS)) != "").select(
        "__id", "__host", "__th", "__pos", h1.alias("__h1"), h2.alias("__h2"), F.size(words(F.col("__line"))).alias("__n")
    )
    lines = shared_table(lines).withColumn("salt", salt("__id"))
    size = docs.select(F.col(id_col).alias("__id"), F.col(host_col).alias("__host")).distinct().groupBy("__host").agg(F.count("*").alias("__docs"))
    seen = lines.select("__host", "__h1", "__h2", "__id", "salt").distinct()
    seen = seen.groupBy("__host", "__h1", "__h2").agg(F.count("*").alias("__in"), salts("salt").alias("salts")).where(F.col("__in") > line_docs)
    # hosts with many frequent lines, and lines that many documents hold, meet their partners in parts
    seen = shared_table(seen).withColumn("part", salt("__h1", "__h2"))
    parts = with_salts(join_back(seen.groupBy("__host").agg(salts("part").alias("parts")), size, ["__host"]), "parts").withColumnRenamed("salt", "part")
    often = join_back(seen, parts, ["__host", "part"], "inner")
    often = often.where((F.col("__in") > line_share * F.col("__docs")) | (F.col("__in") > line_most))
    hit = join_back(lines, with_salts(often.select("__host", "__h1", "__h2", "salts")), ["__host", "__h1", "__h2", "salt"], "inner")
    hit = hit.select("__id", "__th", "__pos", "__n").distinct()
    return hit.groupBy("__id", "__th").agg(F.sum("__n").alias("removed_words"), F.count("*").alias("removed_lines"))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    line_docs: int = LINE_DOCS,
    line_share: float = LINE_SHARE,
    line_most: int = LINE_MOST,
    left_words: int = LEFT_WORDS,
    left_share: float = LEFT_SHARE,
) -> DataFrame:
    """Judge every document by its own text and by how much of it is boilerplate of its host.

    A line (stripped, A-Z lower-cased) found in more than line_docs documents of a host, which are more than
    line_share of its documents or more than line_most, is removed: the limit does not rise without end with
    the host. A document left with fewer than left_words words or less than
    left_share of its words is depleted and rejected. Returns (id_col, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, removed_lines, left_words, kept), a row per input row.

    A null text is empty (no words: it fails). A null host is a host like any other, a null id one
    document. Rows that repeat an id count once towards a line's documents. An empty table gives an empty
    result. Only the three named columns are read. The counts take hashes of lines, distinct per
    document and summed before the shuffle; no text is shuffled.
    """
    stats = text_rules(docs, id_col, text_col, host_col)
    whole = join_back(stats, boilerplate_words(docs, id_col, text_col, host_col, line_docs, line_share, line_most), ["__id", "__th"])
    n, left = F.col("n_words"), F.col("left_words")
    failed = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    return (
        whole.withColumn("left_words", n - F.coalesce("removed_words", F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (left >= left_words) & (left >= left_share * n))
        .select(
            F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            F.coalesce("removed_lines", F.lit(0)).cast("long").alias("removed_lines"), "left_words", "kept",
        )
    )
