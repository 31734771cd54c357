"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_own: ContextVar[list[str]] = ContextVar("_own", default=_written)  # noqa: B039


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a temporary one, a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set; executors of {master} need a folder that all of them share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for files that a query lands or keeps; `drop_shared_tables` deletes it too."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _own.get().append(path)
    return path


def over_all_cores(table: DataFrame) -> DataFrame:
    """table dealt over all cores if it has fewer files than these, as a small one whose rows are one group of one file; a larger one as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if len(table.inputFiles()) < cores else table


#: Rows that dealt() leaves a task in the mean.
TASK_ROWS = 1 << 18


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """About n rows dealt by keys over as many tasks as keep what one of them gets bounded, however long the table is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-n // TASK_ROWS)), *keys)


def shared_table(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the optimiser the true size.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shared_tables(spark: SparkSession) -> int:
    """Delete the tables and folders that this session has written; call it once results are stored."""
    return _drop(spark, _written)


def _drop(spark: SparkSession, written: list[str]) -> int:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while written:
        path = jvm.org.apache.hadoop.fs.Path(written.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


@contextmanager
def tables_of_a_batch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end the tables that are written within, as a stream that never ends would keep those of all its batches."""
    written: list[str] = []
    before = _own.set(written)
    try:
        yield
    finally:
        _own.reset(before)
        _drop(spark, written)
