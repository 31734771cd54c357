"""Stored snapshots: what a version holds, what a merge touches, and what changed between two."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from civicspark.operators.versions import Conflict, SnapshotStore

KEYS = ["source_id", "external_id"]
SCHEMA = "id long, source_id long, external_id string, title string, inserted_at timestamp, updated_at timestamp"
DAY, NOW = dt.datetime(2020, 1, 1), dt.datetime(2021, 5, 5)


def snapshot(spark, names, title="old"):
    return spark.createDataFrame([(k, 1, str(k), title, DAY, DAY) for k in names], SCHEMA)


def batch(spark, *rows):
    return spark.createDataFrame([(1, k, title, n) for n, (k, title) in enumerate(rows)], "source_id long, external_id string, title string, seq int")


def titles(df):
    return {r.external_id: r.title for r in df.collect()}


@pytest.fixture
def store(spark, tmp_path):
    made = SnapshotStore(spark, str(tmp_path / "s"), KEYS, 8)
    made.store(snapshot(spark, range(40)))
    return made


def test_a_merge_touches_only_its_buckets_and_old_versions_stay(spark, tmp_path, store):
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "s" / "data").rglob("*.parquet")}
    reader = store.read()  # planned before the merge, run after it
    assert store.merge(batch(spark, ("7", "new"), ("more", "first")), F.lit(NOW)) == 2
    assert all(f.stat().st_mtime_ns == t for f, t in before.items())
    a, b = store.manifest(1)["parts"], store.manifest(2)["parts"]
    assert a.keys() == b.keys() and 1 <= sum(a[k] != b[k] for k in a) <= 2
    assert titles(reader) == titles(store.read(1)) == {str(k): "old" for k in range(40)}
    assert titles(store.read()) == {str(k): "new" if k == 7 else "old" for k in range(40)} | {"more": "first"}


def test_a_full_store_leaves_nothing_of_the_old(spark, store):
    store.store(snapshot(spark, range(3), "other"))
    assert titles(store.read()) == {"0": "other", "1": "other", "2": "other"} and len(titles(store.read(1))) == 40
    store.store(snapshot(spark, []))
    assert titles(store.read()) == {} and store.versions() == [1, 2, 3]
    store.merge(batch(spark, ("a", "A")), F.lit(NOW))
    assert titles(store.read()) == {"a": "A"}


def test_keys_and_buckets_are_recorded(spark, tmp_path, store):
    path = str(tmp_path / "s")
    assert SnapshotStore(spark, path, KEYS).buckets == 8
    for keys, buckets in ((KEYS, 16), (["external_id"], None)):
        with pytest.raises(ValueError):
            SnapshotStore(spark, path, keys, buckets)
    SnapshotStore(spark, path, KEYS).merge(batch(spark, ("7", "new")), F.lit(NOW))
    assert store.read().count() == 40


def test_changes_between_versions(spark, store):
    store.merge(batch(spark, ("7", "new"), ("more", "first"), ("8", "old")), F.lit(NOW))
    store.delete(spark.createDataFrame([(1, "9"), (1, "unknown"), (2, "8")], "source_id long, external_id string"))
    store.merge(batch(spark, ("7", "newer")), F.lit(NOW))
    told = lambda *v: sorted((r.op, r.external_id, r.title) for r in store.changes(*v).collect())
    assert told(1, 2) == [("insert", "more", "first"), ("update", "7", "new")]
    assert told(2, 3) == [("delete", "9", "old")]
    assert told(1) == [("delete", "9", "old"), ("insert", "more", "first"), ("update", "7", "newer")]
    assert told(4) == [] and [x[0] for x in told(4, 1)] == ["delete", "insert", "update"]


def test_of_two_writers_one_is_refused(spark, tmp_path, store):
    other = SnapshotStore(spark, str(tmp_path / "s"), KEYS)
    write = other._write
    other._write = lambda rows: (write(rows), store.merge(batch(spark, ("1", "first")), F.lit(NOW)))[0]
    with pytest.raises(Conflict):
        other.merge(batch(spark, ("2", "second")), F.lit(NOW))
    assert titles(store.read())["1"] == "first" and titles(store.read())["2"] == "old" and store.versions() == [1, 2]
    assert other.merge(batch(spark), F.lit(NOW)) == 2  # an empty batch makes no version


def test_vacuum_keeps_what_the_last_versions_name(spark, tmp_path, store):
    for n in range(3):
        store.merge(batch(spark, ("7", f"v{n}")), F.lit(NOW))
    want = titles(store.read())
    files = lambda: len(list((tmp_path / "s" / "data").rglob("*.parquet")))
    had = files()
    assert store.vacuum(keep=2) > 0 and files() < had and store.versions() == [3, 4]
    assert titles(store.read()) == want and titles(store.read(3))["7"] == "v1"
    assert store.vacuum(keep=2) == 0


def test_null_keys_and_added_columns(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "n"), ["k"], 4)
    store.store(spark.createDataFrame([(None, 1), (1, 2), (2, 3)], "k long, v int"))
    store.delete(spark.createDataFrame([(None,)], "k long"))
    store.store(store.read().withColumn("w", F.when(F.col("k") == 2, "x")))
    assert sorted(map(tuple, store.changes(2).collect())) == [("update", 2, 3, "x")]
    assert sorted(map(tuple, store.read(1).collect()), key=str) == [(1, 2), (2, 3), (None, 1)]


def test_a_lookup_reads_one_file_and_few_rows(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "l"), KEYS, 16)
    store.store(snapshot(spark, range(3000)))
    found = store.lookup(source_id=1, external_id="1234")
    assert [r.id for r in found.collect()] == [1234] and len(found.inputFiles()) == 1 < 16 == len(store.read().inputFiles())
    assert "EqualTo(external_id,1234)" in found._jdf.queryExecution().executedPlan().toString()
    assert store.lookup(source_id=1, external_id="none").collect() == [] and store.lookup(1, source_id=1, external_id="7").count() == 1
    with pytest.raises(ValueError):
        store.lookup(external_id="1234")
    from pyarrow import parquet

    part = next((tmp_path / "l" / "data").rglob("*.parquet"))
    keys = parquet.read_table(part, partitioning=None).select(KEYS).to_pylist()
    assert keys == sorted(keys, key=lambda r: (r["source_id"], r["external_id"]))


def test_changes_given_as_deltas(spark, store):
    row = lambda k, title, gone: (k, 1, str(k), title, DAY, DAY, gone)
    store.change(spark.createDataFrame([row(3, None, True), row(5, "put", False), row(90, "new", False), row(91, None, True), row(6, None, True), row(6, "back", False)], f"{SCHEMA}, gone boolean"))
    want = {str(k): "old" for k in range(40) if k != 3} | {"5": "put", "90": "new", "6": "back"}
    assert titles(store.read()) == want
