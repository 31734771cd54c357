"""The engine in SQL: functions and a table function that a session's queries may use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.functions.geo import EARTH_M
from civicspark.operators.tagging import MAX_TERMS, NUMBER_WINDOW, STREET, Dictionary, longest

_A = "(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng1) / 2), 2))"
#: SQL functions by name: parameters, result and body.
FUNCTIONS = {
    "haversine_m": ("lng1 double, lat1 double, lng2 double, lat2 double", "double", f"{2 * EARTH_M!r}D * atan2(sqrt({_A}), sqrt(1 - {_A}))"),
    "degrees_between": ("lng1 double, lat1 double, lng2 double, lat2 double", "double", "sqrt(pow(lng1 - lng2, 2) + pow(lat1 - lat2, 2))"),
}


def register(spark: SparkSession, names: DataFrame | None = None) -> None:
    """Make FUNCTIONS known to the session, and with names (name, and perhaps mask) the table function text_hits(text).

    `select d.doc_id, h.* from docs d, lateral text_hits(d.text) h` gives the rows of operators.tagging.text_hits():
    name, mask, start, length, is_longest, tail. Up to MAX_TERMS names; more are an error, and a job for text_hits().
    """
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {result} return {body}")
    if names is None:
        return
    if "mask" not in names.columns:
        names = names.withColumn("mask", F.lit(STREET))
    distinct = names.where("name is not null and name <> ''").groupBy("name").agg(F.bit_or(F.col("mask").cast("int")).alias("mask"))
    terms = sorted((r.name, r["mask"]) for r in distinct.limit(MAX_TERMS + 1).collect())
    if len(terms) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} names")
    sent = spark.sparkContext.broadcast(terms)

    @F.udtf(returnType="name string, mask int, start long, length long, is_longest boolean, tail string")
    class TextHits:
        def __init__(self):
            self.masks = dict(sent.value)
            self.dictionary = Dictionary(list(self.masks))

        def eval(self, text: str):
            if text is None:
                return
            found = self.dictionary.hits(text)
            judged = [h for h in found if self.masks[h[1]] & STREET]
            lost = {h for h, good in zip(judged, longest(judged)) if not good}
            for at, name in found:
                end = at + len(name)
                yield name, self.masks[name], at + 1, len(name), (at, name) not in lost, text[end + 1 : end + 1 + NUMBER_WINDOW]

    spark.udtf.register("text_hits", TextHits)
