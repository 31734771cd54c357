"""Helpers shared by the training-data operators.

Rows of a documents table are told apart by (id, hash of the text), so repeated rows of one id are
handled row by row; a null id is a value like any other and sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.storage import drop_shared_tables, shared_dir, shared_table

__all__ = [
    "SPACE_CHARS", "SPACE_RE", "ascii_lower", "drop_shared_tables", "hash128", "join_back", "numbered", "salt", "salts", "shared_dir", "shared_table", "text_or_empty",
    "with_salts", "words",
]

#: ASCII white space, the only word separator of the operators.
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Java regular expression of the same characters.
SPACE_RE = r"[\x20\x09-\x0D]+"


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(c: Column) -> Column:
    """The maximal runs of characters that are not ASCII white space."""
    return F.array_remove(F.split(c, SPACE_RE), "")


def hash128(c: Column) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(c), F.xxhash64(F.lit(7), c)]


#: Parts that the rows of one key are dealt into; bits of a long.
SALTS = 64


def salt(*columns: str) -> Column:
    """A row's part, from 0 to SALTS - 1, by columns that differ between the rows of one key."""
    return F.pmod(F.xxhash64(F.lit(77), *columns), F.lit(SALTS)).cast("int")


def salts(column: str) -> Column:
    """Aggregate: the parts that occur, as a set of bits."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(column)))


def with_salts(keys: DataFrame, column: str = "salts") -> DataFrame:
    """keys once for each part that occurs, as `salt`: joined on key and salt, no key's rows meet in one task.

    A key with few rows has few parts, so this makes no more rows than it will be joined with.
    """
    occurs = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit(F.col(column), k) == 1)
    return keys.withColumn("salt", F.explode(occurs)).drop(column)


def numbered(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """docs with columns c0, c1 and so on, and what the named ones are called now: no name of theirs meets one of an operator.

    `.toDF(*docs.columns)` gives the names back.
    """
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), [f"c{docs.columns.index(n)}" for n in names]


def join_back(docs: DataFrame, extra: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Null-safe join of extra to docs on equally named keys; the keys of docs stay."""
    renamed = extra.select([F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in extra.columns])
    on = [docs[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return docs.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])  # a semi join has none of these
