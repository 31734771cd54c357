"""Records of JSON collections: any layout, any split, broken files."""

import json
import random

import pytest

from civicspark.sources import feeds
from civicspark.sources.records import records

SPLITS = ("128m", "900b")


@pytest.fixture
def split(spark):
    def to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b" if size != "128m" else "4m")

    yield to
    to("128m")


def put(folder, name, content):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(content, encoding="utf-8")
    return str(folder)


def read(spark, *args, **kw):
    found = {}
    for r in records(spark, *args, **kw).orderBy("file", "pos").collect():
        found.setdefault(r.file.rsplit("/", 1)[1], []).append((r.pos, json.loads(r.value)))
    return found


def feature(k):
    return {"type": "Feature", "properties": {"n": k, "t": 'a } , {"\\ ] é\\'}, "geometry": {"type": "Polygon", "coordinates": [[[k, 2], [3, 4]]]}}


def collections(n):
    """The same features in layouts of all kinds."""
    fs = [feature(k) for k in range(n)]
    around = {"type": "FeatureCollection", "crs": {"a": [1, {"features": [7]}], "b": {}}, "features": fs, "more": [{"x": 1}, {"y": 2}], "none": []}
    line = [json.dumps(f) for f in fs]
    return fs, {
        "one.json": json.dumps(around), "pretty.json": json.dumps(around, indent=2) + "\n", "lines.json": '{"type":"FeatureCollection",\n"features": [\n' + ",\n".join(line) + "\n]\n}\n",
        "bracket.json": '{"features": [' + "\n,".join(line) + "]}", "raw.json": json.dumps(around, ensure_ascii=False), "last.json": '{"features":[' + ",".join(line) + '], "z": {"q": {}}}\n\n',
    }


@pytest.mark.parametrize("size", SPLITS)
def test_mixed_layouts_in_one_folder(spark, tmp_path, split, size):
    fs, files = collections(9)
    for name, content in files.items():
        path = put(tmp_path / "m", name, content)
    split(size)
    got = read(spark, path, "features")
    assert got.keys() == files.keys()
    for name, content in files.items():
        assert [v for _, v in got[name]] == fs
        raw = content.encode()
        assert all(raw[p:].lstrip()[:1] == b"{" for p, _ in got[name])
    rows = feeds.geojson_features(spark, path).collect()
    assert len(rows) == 9 * len(files) and all(json.loads(r.shape)["type"] == "Polygon" for r in rows)


def test_files_of_a_line_form_and_of_one_line(spark, tmp_path):
    """A folder with both, and a file whose first feature stands on the line of the bracket."""
    line = [json.dumps(feature(k)) for k in range(8)]
    put(tmp_path / "f", "a.json", '{"type":"FeatureCollection","features":[\n' + ",\n".join(line[:3]) + "\n]}")
    path = put(tmp_path / "f", "b.json", '{"type":"FeatureCollection","features":[' + ",".join(line[3:]) + "]}")
    assert feeds.geojson_features(spark, path).count() == 8
    path = put(tmp_path / "g", "a.json", '{"features":[' + ",\n".join(line[:4]) + "\n]}")
    assert feeds.geojson_features(spark, path).count() == 4


@pytest.mark.parametrize("size", SPLITS)
def test_outermost_arrays_and_scripts(spark, tmp_path, split, size):
    rows = [[k, 'x"]; [', {"a": [k]}, None] for k in range(25)]
    put(tmp_path / "r", "a.js", "var markers = " + json.dumps(rows) + ";\n")
    put(tmp_path / "r", "b.js", "  [" + "\n,".join(map(json.dumps, rows)) + "]")
    path = put(tmp_path / "r", "c.js", "[ ]")
    split(size)
    got = read(spark, path, sep="]")
    assert [v for _, v in got["a.js"]] == rows and [v for _, v in got["b.js"]] == rows and "c.js" not in got
    forum = put(tmp_path / "q", "a.json", json.dumps({"n": {"rows": [1]}, "rows": rows, "end": [[9]]}))
    assert [v for _, v in read(spark, forum, "rows", sep="]")["a.json"]] == rows


@pytest.mark.parametrize("seed", range(3))
def test_random_values_and_splits(spark, tmp_path, split, seed):
    rnd = random.Random(seed)

    def value(depth):
        kind = rnd.randrange(7 if depth < 4 else 5)
        if kind == 5:
            return [value(depth + 1) for _ in range(rnd.randrange(4))]
        if kind == 6:
            return {"".join(rnd.choice('ab"\\}]{[:,é') for _ in range(rnd.randrange(5))): value(depth + 1) for _ in range(rnd.randrange(4))}
        return [None, rnd.random(), "".join(rnd.choice('x"\\}]{[:,é\n ') for _ in range(rnd.randrange(12))), True, -3][kind]

    for n in range(2):
        top = {"a": value(0), "items": [{"v": value(1), "k": k} for k in range(rnd.randrange(12))], "b": value(0)}
        path = put(tmp_path / "v", f"{n}.json", json.dumps(top, indent=rnd.choice([None, 1]), ensure_ascii=rnd.random() < 0.5))
        (tmp_path / "v" / f"{n}.want").write_text(json.dumps(top["items"]))
    split(f"{rnd.choice((60, 150, 400))}b")
    got = read(spark, path + "/*.json", "items")
    for n in range(2):
        assert [v for _, v in got.get(f"{n}.json", [])] == json.loads((tmp_path / "v" / f"{n}.want").read_text())


def test_files_are_split_over_tasks(spark, tmp_path, split):
    path = put(tmp_path / "s", "a.json", json.dumps({"features": [feature(k) for k in range(600)]}))
    split("8k")
    raw = spark.read.text(path, lineSep="}")
    assert raw.rdd.getNumPartitions() > 8 and len(read(spark, path, "features")["a.json"]) == 600


def test_one_record_over_many_ranges(spark, tmp_path, split):
    rows = [{"a": [{"b": "}" * 50} for _ in range(100)]}, {"c": 1}]
    path = put(tmp_path / "o", "a.json", json.dumps({"x": rows}))
    split("900b")
    assert [v for _, v in read(spark, path, "x")["a.json"]] == rows


@pytest.mark.parametrize("content", ['{"features":[{"a":1},{"b":', '{"features":[{"a":1},{"b":"x}', '{"features":[{"a":1}'])
def test_truncated_files_are_named(spark, tmp_path, content):
    put(tmp_path / "t", "good.json", '{"features":[{"a":1}]}\n')
    path = put(tmp_path / "t", "cut.json", content)
    with pytest.raises(ValueError, match="cut.json"):
        records(spark, path, "features").collect()


def test_empty_collections(spark, tmp_path):
    put(tmp_path / "e", "a.json", '{"type": "FeatureCollection", "features": []}')
    put(tmp_path / "e", "b.json", '{"features": {"a": 1, "b": {}}}')
    path = put(tmp_path / "e", "c.json", "{}\n")
    assert records(spark, path, "features").count() == 0
