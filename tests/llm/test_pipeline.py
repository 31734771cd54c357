from collections import Counter

import pytest



import corpus_pipeline  # noqa: E402
from civicspark.llm.quality_classifier import quality_scores  # noqa: E402
from tests.llm.test_mixing import slow_targets  # noqa: E402
from tests.llm.test_simhash import slow_fingerprint, slow_groups  # noqa: E402

DATA = "/root/testdata/sf0.001"


def slow_lines(docs):
    """{id: text} -> the same after line dedup."""
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    first, holders = {}, {}
    for i in sorted(docs):
        for x in docs[i].split("\n"):
            if len(key(x)) >= 10:
                first.setdefault(key(x), i)
                holders.setdefault(key(x), set()).add(i)
    return {i: "\n".join(x for x in t.split("\n") if len(holders.get(key(x), ())) < 2 or first[key(x)] == i) for i, t in docs.items()}


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        seen.append(docs := spark.read.parquet(f"{tmp_path}/{k}"))
        assert k == 4 or docs.columns == columns, name
    first, lines, near, mixed, packed = ([r for r in d.collect()] for d in seen)
    kept = {r.doc_id for r in quality_scores(spark.read.parquet(f"{DATA}/documents.parquet")).collect() if r.kept}
    assert {r.doc_id for r in first} == kept and len(first) == len(kept)
    texts = slow_lines({r.doc_id: r.text for r in first})
    assert {r.doc_id: r.text for r in lines} == texts and all(r.n_chars == len(r.text) for r in lines)
    groups = slow_groups([(i, slow_fingerprint(t)) for i, t in texts.items()], 2)
    assert Counter(r.doc_id for r in near) == Counter(set(groups.values()))
    size = {r.doc_id: len(r.text.split()) for r in near}
    source = {r.doc_id: r.source for r in near}
    total, taken = Counter(), Counter()
    for i, n in size.items():
        total[source[i]] += n
    copies = Counter(r.doc_id for r in mixed)
    assert max(copies.values()) <= 2
    for i, n in copies.items():
        taken[source[i]] += n * size[i]
    want = slow_targets(total)
    assert sum(taken.values()) == pytest.approx(sum(want.values()), rel=0.1)
    pieces = Counter((r.doc_id, r.piece) for r in packed)
    assert {i for i, _ in pieces} == set(copies) and all(n == copies[i] for (i, _), n in pieces.items())


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    used = Counter()
    for r in out.collect():
        used[r.sequence_id] += r.length
    assert used and max(used.values()) <= 1024
