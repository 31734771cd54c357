"""Line deduplication: drop lines that other documents hold too, reassemble the rest by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import SPACE_CHARS, ascii_lower, hash128, join_back, numbered, salt, salts, shared_table, text_or_empty, with_salts


def line_key(line: Column) -> Column:
    """A line without ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def _lost_lines(base: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(__id, __th, __lost): the places of the lines that rows of base (__id, __text) lose."""
    keyed = base.select("__id", F.xxhash64("__text").alias("__th"), F.posexplode(F.split("__text", "\n", -1)).alias("__pos", "__line"))
    keyed = keyed.select("__id", "__th", "__pos", line_key(F.col("__line")).alias("__key")).where(F.char_length("__key") >= min_chars)
    h1, h2 = hash128(F.col("__key"))
    occ = shared_table(keyed.select("__id", "__th", "__pos", h1.alias("__h1"), h2.alias("__h2"))).withColumn("salt", salt("__id"))

    per_doc = occ
    null_id = F.bool_or(F.col("__id").isNull())
    if min_docs > 2:
        per_doc = occ.select("__id", "__h1", "__h2", "salt").distinct()
        enough = F.count("*") >= min_docs
    else:  # two documents: the smallest and the largest id differ
        enough = (F.min("__id") != F.max("__id")) | (null_id & F.min("__id").isNotNull())
    keep = F.when(null_id, F.lit(None)).otherwise(F.min("__id"))
    holders = per_doc.groupBy("__h1", "__h2").agg(keep.alias("__keep"), enough.alias("__enough"), salts("salt").alias("salts"))
    # a line that very many documents hold meets them in as many parts as there are salts
    holders = with_salts(holders.where("__enough").select("__h1", "__h2", "__keep", "salts"))
    return (
        occ.join(holders, ["__h1", "__h2", "salt"])
        .where(~F.col("__id").eqNullSafe(F.col("__keep")))
        .groupBy("__id", "__th")
        .agg(F.collect_set("__pos").alias("__lost"))
    )


def _kept_text() -> Column:
    """The text without the lines at the places __lost."""
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__lost"))
    rest = F.array_join(F.transform(kept, lambda i: F.get(F.col("__lines"), i)), "\n")
    return F.when(F.col("__lost").isNull(), F.col("__text")).otherwise(rest)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Drop every line whose key has min_chars code points or more and stands in min_docs documents or
    more, except in the document with the smallest id that holds it.

    Returns (id_col, kept_text, n_lines, n_dropped), one row per input row. Null and empty texts are one
    empty line. A null id is one document and sorts first. Rows that repeat an id are one document when
    documents are counted, and each keeps its own row. An empty table gives an empty result. Columns
    other than the two named are not read, so their names cannot clash.

    Lines are compared by a 128-bit hash of the key. Only hashes and positions are shuffled to count
    them, partial counts first; the texts are shuffled once, to meet the positions they lose.
    """
    base = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))
    lost = _lost_lines(base, min_chars, min_docs)
    whole = join_back(base.withColumn("__th", F.xxhash64("__text")), lost, ["__id", "__th"])
    return whole.withColumn("__lines", F.split("__text", "\n", -1)).select(
        F.col("__id").alias(id_col),
        _kept_text().alias("kept_text"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.when(F.col("__lost").isNull(), 0).otherwise(F.size("__lost")).cast("long").alias("n_dropped"),
    )


def without_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", **kw) -> DataFrame:
    """docs with the texts that line_dedup() leaves; a column length_col, if there is one, holds their lengths.

    Every row and column stays, whatever the columns are called. Null texts become empty ones.
    """
    rows, (key, text) = numbered(docs, id_col, text_col)
    keyed = rows.withColumns({"__id": F.col(key), "__text": text_or_empty(text)})
    lost = _lost_lines(keyed.select("__id", "__text"), kw.get("min_chars", 10), kw.get("min_docs", 2))
    whole = join_back(keyed.withColumn("__th", F.xxhash64("__text")), lost, ["__id", "__th"])
    whole = whole.withColumn("__lines", F.split("__text", "\n", -1)).withColumn(text, _kept_text())
    if length_col in docs.columns:
        length = f"c{docs.columns.index(length_col)}"
        whole = whole.withColumn(length, F.char_length(text).cast(rows.schema[length].dataType))
    return whole.select(rows.columns).toDF(*docs.columns)
