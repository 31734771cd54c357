"""The stored street index against a search over all names."""

import random

from civicspark.functions.text import german_tokens
from civicspark.operators.search import asked_with_rarest_keys, search_contains
from civicspark.operators.search_index import StreetIndex

SCHEMA = "id long, name string, district string, street_number_count int"
COLUMNS = ["search", "name", "district", "street_number_count", "cost", "rank"]


def test_index_after_upserts_equals_a_search_over_all(spark, tmp_path):
    rnd = random.Random(2)
    word = lambda: rnd.choice(["Garten", "Gärten", "Häuser", "Haus", "Alte", "Alter", "am", "Ufer", "ufern", "Straße", "10", "Ölberg", "zu"])
    make = lambda ids: [(i, " ".join(word() for _ in range(rnd.randrange(1, 4))), rnd.choice("ab"), i * 7 % 13) for i in ids]
    names = {r[0]: r for r in make(range(60))}
    searches = spark.createDataFrame([(s,) for s in ("alte gärten", "Haus", "ufer", "straß", "der Garten", "10", "xyz", "am", "häuse", "ölbe", "Gar")], "search string")
    index = StreetIndex(spark, str(tmp_path / "i"), buckets=8)
    frame = lambda rows: spark.createDataFrame(list(rows), SCHEMA)
    index.upsert(frame(names.values()))
    for step in range(2):
        changed = {r[0]: r for r in make(rnd.sample(range(80), 12))}
        gone = [i for i in rnd.sample(range(60), 5) if i not in changed]
        index.upsert(frame(changed.values()), spark.createDataFrame([(i,) for i in [*gone, next(iter(changed))]], "id long"))
        names = {i: r for i, r in (names | changed).items() if i not in gone}
        assert index.postings.read().distinct().count() == index.postings.read().count()
    index = StreetIndex(spark, str(tmp_path / "i"))
    got = sorted(map(tuple, index.search(searches).select(COLUMNS).collect()))
    want = search_contains(searches, frame(names.values()).drop("id"), tokens=german_tokens)
    # equal names of one district and count are one row there
    assert {g[:-1] for g in got} == {tuple(w)[:-1] for w in want.select(COLUMNS).collect()} and len(got) > 15
    assert {r.name for r in index.search(spark.createDataFrame([("gartens",)], "search string")).collect()} >= {r[1] for r in names.values() if "Garten" in r[1].split() and r[3] > 11}


def test_a_search_reads_the_buckets_of_its_keys(spark, tmp_path):
    index = StreetIndex(spark, str(tmp_path / "i"), buckets=64)
    index.upsert(spark.createDataFrame([(i, f"{chr(97 + i % 26) * 4}weg {i}", "x", i) for i in range(400)], SCHEMA))
    asked = spark.createDataFrame([("cccc",)], "key string")
    assert 0 < len(index.postings.read_for(asked).inputFiles()) <= 2 < 30 < len(index.postings.read().inputFiles())
    assert index.search(spark.createDataFrame([("cccc",)], "search string")).count() == 10
    assert index.search(spark.createDataFrame([], "search string")).count() == 0


def test_a_search_meets_the_names_of_its_rarest_key(spark, tmp_path):
    """Of names that nearly all share a search's longest word only those with its number are looked at."""
    index = StreetIndex(spark, str(tmp_path / "i"), buckets=4)
    index.upsert(spark.createDataFrame([(i, f"Alter Garten {i}", "x", 1) for i in range(100, 500)], SCHEMA))
    searches = spark.createDataFrame([("der alte gärten 257",), ("garten 257",), ("gartens 999",)], "search string")
    seen = []

    def found_by(keys):
        seen.extend(r.key for r in keys.collect())
        return index.postings.read_for(keys)

    asked = asked_with_rarest_keys(searches, german_tokens, found_by).select("search", "__k").collect()
    assert {(r.search, r["__k"]) for r in asked} == {("der alte gärten 257", "w257"), ("garten 257", "c257"), ("garten 257", "w257")}
    assert "wgar" in seen
    assert {(r.search, r.name) for r in index.search(searches).collect()} == {(s, "Alter Garten 257") for s in ("der alte gärten 257", "garten 257")}
