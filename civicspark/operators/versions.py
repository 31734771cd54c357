"""Stored snapshots with versions: files by a hash of the keys, and a manifest per version that names them.

Files are written once and never changed. A version is what its manifest lists, which appears under its name in one
rename; so a reader sees one version whatever is being written, a failed or repeated write leaves
nothing but files that no manifest names, and of two writers that began from one version the second is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from civicspark.operators.merge import merge_snapshot

#: Parts of a stored snapshot; a batch rewrites those that its keys fall in.
BUCKETS = 256


class Conflict(RuntimeError):
    """Another writer has made this version."""


class SnapshotStore:
    """A table of one row per key in a folder, in numbered versions from 1.

    The keys and the number of buckets are those of the first store() and hold for all versions; opening a
    folder with others is an error. Any file system that Spark reaches will do if it renames at once. by: those of the keys
    that decide on the bucket, all by default; files are sorted by them, so that filters on them skip parts of files.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int | None = None, by: list[str] | None = None):
        self.spark, self.path, self.keys, self.by = spark, path.rstrip("/"), list(keys), list(by or keys)
        known = self.manifest(None) if self.versions() else None
        if known and (known["keys"] != self.keys or known["by"] != self.by or buckets not in (None, known["buckets"])):
            raise ValueError(f"{path} is stored by {known['keys']} in {known['buckets']} buckets of {known['by']}")
        self.buckets = known["buckets"] if known else buckets or BUCKETS

    # files of the store, through Spark's own file systems

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, at = self._files(), self._at(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and n[0] != "."]

    def manifest(self, version: int | None) -> dict:
        """keys, buckets, schema and parts (bucket to folder) of a version, the last one without a number."""
        version = version or max(self.versions())
        stream = self._files().open(self._at(f"versions/{version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, version: int, schema: StructType, parts: dict[str, str]) -> int:
        jvm, fs = self.spark._jvm, self._files()
        aside = f"versions/.{uuid.uuid4().hex}"
        stream = fs.create(self._at(aside))
        stream.write(bytearray(json.dumps({"version": version, "keys": self.keys, "by": self.by, "buckets": self.buckets, "schema": schema.jsonValue(), "parts": parts}).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # none: does not write over
        try:
            context.rename(fs.makeQualified(self._at(aside)), fs.makeQualified(self._at(f"versions/{version:08d}.json")), options)
        except Exception as e:
            fs.delete(self._at(aside), False)
            if fs.exists(self._at(f"versions/{version:08d}.json")):
                raise Conflict(f"version {version} of {self.path} is there already") from e
            raise
        return version

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Write rows to a new folder and give the parts that came out. A bucket too large for a task is several files, each sorted."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").sortWithinPartitions("bucket", *self.by).write.options(**self._skipping(rows)).partitionBy("bucket").parquet(f"{self.path}/{folder}")
        return {n.split("=")[1]: f"{folder}/{n}" for n in self._names(folder) if n.startswith("bucket=")}

    def _skipping(self, rows: DataFrame) -> dict[str, str]:
        """Bloom filters on the columns that rows are looked up by."""
        return {f"parquet.bloom.filter.enabled#{c}": "true" for c in self.by if rows.schema[c].dataType.typeName() != "boolean"}

    def _rows(self, manifest: dict, buckets: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/{folder}" for bucket, folder in manifest["parts"].items() if buckets is None or bucket in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # what a user does

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one without a number."""
        return self._rows(self.manifest(version))

    def read_for(self, wanted: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of a version in the buckets that the wanted rows (columns `by`) fall in: a superset of the rows with their values."""
        return self._rows(self.manifest(version), self._touched(wanted))

    def lookup(self, version: int | None = None, **key) -> DataFrame:
        """The rows with these values of the columns `by`: one bucket is read, of whose files Parquet skips what cannot have them."""
        if set(key) != set(self.by):
            raise ValueError(f"rows are looked up by {self.by}")
        kinds = {f["name"]: f["type"] for f in self.manifest(version)["schema"]["fields"]}
        asked = self.spark.range(1).select(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in key.items()])
        found = self.read_for(asked, version)
        for c, v in key.items():
            found = found.where(F.col(c) == F.lit(v).cast(kinds[c]))
        return found

    def _touched(self, rows: DataFrame) -> set[str]:
        return {str(r[0]) for r in rows.select(self._bucket()).distinct().collect()}  # numbers below `buckets`

    def store(self, snapshot: DataFrame) -> int:
        """A version that holds the snapshot and nothing else. Rows of equal keys are all kept; keys may be null."""
        before = max(self.versions(), default=0)
        return self._commit(before + 1, snapshot.schema, self._write(snapshot))

    def _changed(self, batch: DataFrame, change) -> int:
        before = max(self.versions())
        manifest = self.manifest(before)
        touched = self._touched(batch)
        if not touched:
            return before
        old = self._rows(manifest, touched)
        new = self._write(change(old))
        parts = {b: f for b, f in manifest["parts"].items() if b not in touched} | new
        return self._commit(before + 1, old.schema, parts)

    def merge(self, batch: DataFrame, as_of: Column, **how) -> int:
        """The version after merge_snapshot(): only the buckets that the batch's keys fall in are read, joined and written."""
        return self._changed(batch, lambda old: merge_snapshot(old, batch, self.keys, as_of, **how))

    def change(self, deltas: DataFrame) -> int:
        """The version after deltas: rows of the table with `gone`, true where a row of these keys goes and false where this one is put."""
        last = deltas.groupBy(*self.keys).agg(F.min_by(F.struct(*[c for c in deltas.columns if c not in self.keys]), "gone").alias("__d"))

        def apply(old: DataFrame) -> DataFrame:
            kept = old.join(last.select(*self.keys), self.keys, "left_anti")
            put = last.where(~F.col("__d.gone")).select(*self.keys, "__d.*").select(old.columns)
            return kept.unionByName(put)

        return self._changed(deltas, apply)

    def delete(self, keys: DataFrame) -> int:
        """The version without the rows of these keys; a null key matches a null key."""
        gone = keys.select(*[F.col(k).alias(f"__g_{k}") for k in self.keys]).distinct()

        def without(old: DataFrame) -> DataFrame:
            on = F.lit(True)
            for k in self.keys:
                on = on & old[k].eqNullSafe(gone[f"__g_{k}"])
            return old.join(gone, on, "left_anti")

        return self._changed(keys, without)

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """(op, keys, other columns): the net changes from one version to another: insert, update with the new values, delete with the old.

        Only buckets whose files differ are read, on both sides. Keys must be unique and not null. Columns are
        those of the later version; a column that the earlier one lacks counts as null there.
        """
        a, b = self.manifest(since), self.manifest(until)
        differ = {k for k in a["parts"].keys() | b["parts"].keys() if a["parts"].get(k) != b["parts"].get(k)}
        old, new = self._rows(a, differ), self._rows(b, differ)
        values = [c for c in new.columns if c not in self.keys]
        kinds = {f.name: f.dataType for f in new.schema}
        had = [(F.col(c) if c in old.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in values]
        left = old.select(*self.keys, F.struct(*had, F.lit(1).alias("__is")).alias("__old"))
        right = new.select(*self.keys, F.struct(*values, F.lit(1).alias("__is")).alias("__new"))
        both = left.join(right, self.keys, "full_outer")
        op = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "delete").otherwise("update")
        moved = both.where(~F.col("__old").eqNullSafe(F.col("__new"))).withColumn("__row", F.coalesce("__new", "__old"))
        return moved.select(op.alias("op"), *self.keys, *[F.col("__row")[c].alias(c) for c in values])

    def vacuum(self, keep: int = 1) -> int:
        """Forget all but the last `keep` versions and delete the files that none of those names; how many folders went.

        Not while a writer is at work: its files have no manifest yet.
        """
        fs, versions = self._files(), self.versions()
        kept = versions[-max(keep, 1) :]
        used = {f.rsplit("/", 1)[0]: set() for v in kept for f in self.manifest(v)["parts"].values()}
        for v in kept:
            for folder in self.manifest(v)["parts"].values():
                used[folder.rsplit("/", 1)[0]].add(folder.rsplit("/", 1)[1])
        for v in versions[: len(versions) - len(kept)]:
            fs.delete(self._at(f"versions/{v:08d}.json"), False)
        gone = 0
        for name in self._names("data"):
            parts = used.get(f"data/{name}")
            if parts is None:
                gone += bool(fs.delete(self._at(f"data/{name}"), True))
                continue
            for part in self._names(f"data/{name}"):
                if part.startswith("bucket=") and part not in parts:
                    gone += bool(fs.delete(self._at(f"data/{name}/{part}"), True))
        return gone
