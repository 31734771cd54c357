import math
import re
import zlib

import numpy as np
import pytest

from civicspark.llm.toxicity import FEATURES, LEXICON_SIZE, Flags, features, held_out, terms, toxicity, train

DATA = "/root/testdata/sf0.01"


def named(text, *lexicon):
    return dict(zip(FEATURES, features(text, Flags(frozenset(lexicon)))))


def test_features():
    f = named("You are an IDIOT!! truly, i.d.i.o.t and 1d10t my friend", "idiot", "idio*")
    assert f["terms"] == 1 and f["stems"] == 1 and f["term_near_second"] == pytest.approx(2 / 10)  # the third hit is seven words away
    assert f["hidden_terms"] == pytest.approx(2 / 10) and f["obfuscated"] == pytest.approx(2 / 10)
    assert f["capital_words"] == pytest.approx(1 / 10) and f["exclaims"] == pytest.approx(1 / 10) and f["any_hit"] == 1
    assert named("", "idiot") == dict.fromkeys(FEATURES, 0.0)
    assert named("iiiidioooot", "idiot")["hidden_terms"] == 1
    assert terms("Ab!") == [] and terms("(Longer,") == ["longer", "long*", "longe*"]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    known = [(r.toxic, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([s.predicted == y for y, s in known]) > 0.9
    toxic, clean = ([s.score for y, s in known if y == want] for want in (1, 0))
    assert np.mean(np.less.outer(clean, toxic)) + 0.5 * np.mean(np.equal.outer(clean, toxic)) > 0.85


def test_held_out_labels_are_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.selectExpr("doc_id", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0 then 1 - toxic else toxic end as toxic")
    a, b = ({r.doc_id: r.score for r in toxicity(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_edge_cases(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "some words", 1), (3, "words", 1), (3, "word " * 30_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    none = spark.createDataFrame([(1, None), (2, 7), (None, 1)], "doc_id long, toxic int")
    assert [r.score for r in toxicity(docs, none).collect()] == [0.0] * 5
    one = spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "doc_id long, toxic int")
    assert {r.score for r in toxicity(docs, one).collect()} == {1.0}
    assert toxicity(docs.limit(0), one).count() == 0


SECOND = set("you your yours yourself u ya du dich dir dein deine deinen euch ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())


def slow_features(text, lexicon):
    """Features by single words, from their description."""
    w = text.split()
    if not w:
        return dict.fromkeys(FEATURES, 0.0)
    n = len(w)
    bare = [x.strip(".,;:!?\"'()[]*#$%&") for x in w]
    low = [b.lower() for b in bare]
    word = [len(x) >= 3 and x.isalpha() for x in low]
    term = [ok and x in lexicon for ok, x in zip(word, low)]
    stem = [ok and any(f"{x[:k]}*" in lexicon for k in (4, 5, 6, 7) if len(x) > k) for ok, x in zip(word, low)]
    odd = [not b.isalpha() and bool(re.search(r"\w[@$!|*.#_0-9-]+\w", b)) and any(c.isalpha() for c in b) for b in bare]
    stretched = [bool(re.search(r"([^\W\d_])\1\1", x)) for x in low]
    hidden = []
    for k, x in enumerate(low):
        plain = ""
        if odd[k]:
            plain = "".join(c for c in x.translate(str.maketrans("013457@$!|", "oieastasii")) if c.isalnum())
        if stretched[k] and not term[k]:
            plain = re.sub(r"(.)\1+", r"\1", x)
        hidden.append(bool(plain) and plain in lexicon)
    second = [x in SECOND for x in low]
    hits = [k for k in range(n) if term[k] or stem[k] or hidden[k]]
    near = sum(any(abs(k - j) <= 6 for j in range(max(0, k - 6), min(n, k + 7)) if second[j]) for k in hits)
    return dict(zip(FEATURES, (
        sum(term) / n, sum(stem) / n, sum(term), sum(stem), near / n, sum(second) / n, sum(len(b) > 1 and b.isupper() for b in bare) / n,
        sum("A" <= c <= "Z" for c in text) / len(text), sum("!" in x for x in w) / n, sum("?" in x for x in w) / n,
        sum(not b or len(x) > 1 and x[-2] == x[-1] and not x[-1].isalnum() for b, x in zip(bare, w)) / n, sum(odd) / n, sum(hidden) / n, sum(stretched) / n, math.log1p(n), float(bool(hits)),
    )))


def test_features_and_scores_against_brute_force(spark):
    """Features of all documents by plain loops, trees walked node by node, calibration by straight lines."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    model = train(docs, labels)
    assert 0 < len(model.lexicon) < LEXICON_SIZE  # the bound cuts nothing here
    odd = {-1: "Yoooou ARE an " + " ".join(sorted(t for t in model.lexicon if "*" not in t)[:40]) + " 1d1ot!! " * 30, -2: "you " * 9, -3: "x" * 90}
    for i, t in (texts | odd).items():
        assert dict(zip(FEATURES, features(t, Flags(model.lexicon)))) == pytest.approx(slow_features(t, model.lexicon)), i
    at, value = (np.array(x) for x in (model.calibration.boundaries, model.calibration.predictions))

    def walk(node, x):
        while node.numDescendants():
            node = node.leftChild() if x[node.split().featureIndex()] <= node.split().threshold() else node.rightChild()
        return node.prediction()

    trees = [(w, t._call_java("rootNode")) for w, t in zip(model.trees.treeWeights, model.trees.trees)]
    for r in toxicity(docs, labels).collect()[::20]:
        x = list(slow_features(texts[r.doc_id], model.lexicon).values())
        margin = sum(w * walk(root, x) for w, root in trees)
        assert r.score == pytest.approx(float(np.interp(1 / (1 + math.exp(-2 * margin)), at, value)), abs=1e-6)


def test_counts_do_not_saturate():
    few, many = (named("idiot " * n, "idiot")["terms"] for n in (15, 400))
    assert (few, many) == (15, 400)


def test_clashing_names_of_labels(spark):
    rows = [(k, f"you {'idiot' if k % 2 else 'friend'} number{k} of many", 0.5, "x") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, label string")
    labels = spark.createDataFrame([(k, k % 2, "t", 1, 9) for k in range(60)], "doc_id long, toxic int, text string, fold int, label int")
    got = toxicity(docs, labels).collect()
    assert len(got) == 60 and np.mean([r.score for r in got if r.doc_id % 2]) > np.mean([r.score for r in got if r.doc_id % 2 == 0])
    assert docs.where(held_out("doc_id")).count() == sum(r.held_out for r in got)
