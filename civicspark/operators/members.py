"""Rows whose key may be among some: a filter of bits in place of a shuffle of the whole table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key, of which the filter has a power of two, and bits at least and at most, as powers of two (at most 16 megabytes).
BITS_A_KEY, LEAST_BITS, MOST_BITS = 8, 16, 27


def likely_in(table: DataFrame, key: str, some: DataFrame) -> DataFrame:
    """The rows of table whose key is in some, and a few others; some, a stored table, is not held by any task or driver.

    Bits of the keys' hashes are bitmaps of 4 kilobytes by bucket, which are broadcast. More keys let more other rows pass, none fewer.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(BITS_A_KEY * max(1, some.count())))))
    place = F.pmod(F.xxhash64(F.col(key).cast(some.schema[key].dataType)), F.lit(1 << bits)) + 1
    filled = some.select(place.alias("__place")).groupBy(F.bitmap_bucket_number("__place").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__place")).alias("__bits"))
    met = table.withColumn("__place", place).withColumn("__bucket", F.bitmap_bucket_number("__place")).join(F.broadcast(filled), "__bucket")
    at = F.bitmap_bit_position("__place")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.call_function("getbit", byte, (at % 8).cast("int")) == 1).select(*table.columns)
