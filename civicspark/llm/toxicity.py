"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import shared_table, text_or_empty

#: Labelled documents that the model is fitted on: those with the smallest hash of the id.
TRAIN_ROWS = 9000
#: Terms of the lexicon: in how many toxic documents of the sample one stands at least, and how much likelier they are toxic.
LEXICON_LIFT, LEXICON_DOCS = 8.0, 4
#: Terms that the driver and the tasks hold at most, the most telling first; the sample is bounded, and so is what it may hold.
LEXICON_SIZE = 50_000
#: Lengths of word beginnings that are terms too.
STEMS = (4, 5, 6, 7)
#: Words around a lexicon term in which a second person counts as near.
NEAR = 6
#: Words whose flags a Python worker remembers; past it the memory starts anew. Longer words are not remembered.
MEMO, MEMO_CHARS = 600_000, 64

EDGE = ".,;:!?\"'()[]*#$%&"
#: Second persons of the languages in the corpus.
SECOND = frozenset("you your yours yourself u ya du dich dir dein deine deinen euch ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Characters written for letters.
LEET = str.maketrans("013457@$!|", "oieastasii")
INSIDE = re.compile(r"\w[@$!|*.#_0-9-]+\w")
FLAGS = ("term", "stem", "second", "capitals", "obfuscated", "hidden_term", "exclaims", "question", "marks", "stretched")
FEATURES = (
    "term_density", "stem_density", "terms", "stems", "term_near_second", "second_density", "capital_words", "capital_letters",
    "exclaims", "questions", "marks", "obfuscated", "hidden_terms", "stretched", "log_words", "any_hit",
)


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def terms(word: str) -> list[str]:
    """What a word may be found by: itself, without marks at its edges, and its beginnings."""
    low = word.strip(EDGE).lower()
    if len(low) < 3 or not low.isalpha():
        return []
    return [low, *[f"{low[:n]}*" for n in STEMS if len(low) > n]]


class Flags(dict):
    """word -> one bit for each of FLAGS, learned as words are met."""

    def __init__(self, lexicon: frozenset):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        bare = word.strip(EDGE)
        low = bare.lower()
        found = [t in self.lexicon for t in terms(word)] or [False]
        odd = not bare.isalpha() and bool(INSIDE.search(bare)) and any(c.isalpha() for c in bare)
        plain = re.sub(r"[^\w]|_", "", low.translate(LEET)) if odd else ""
        stretched = bool(re.search(r"([^\W\d_])\1\1", low))
        if stretched and not found[0]:
            plain = re.sub(r"(.)\1+", r"\1", low)
        bits = (
            found[0], any(found[1:]), low in SECOND, len(bare) > 1 and bare.isupper(), odd, bool(plain) and plain in self.lexicon,
            "!" in word, "?" in word, not bare or word[-2:-1] == word[-1:] and not word[-1:].isalnum(), stretched,
        )
        got = sum(b << k for k, b in enumerate(bits))
        if len(word) <= MEMO_CHARS:
            self[word] = got
        return got


def features(text: str, flags: Flags) -> list[float]:
    """The dense features of a text, in the order of FEATURES; shares and densities, except the counts of hits and the last two."""
    if len(flags) > MEMO:
        flags.clear()
    found = text.split()
    n = len(found)
    if not n:
        return [0.0] * len(FEATURES)
    seen = np.fromiter(map(flags.__getitem__, found), dtype=np.int64, count=n)
    by = np.bincount(seen, minlength=1 << len(FLAGS))
    at = np.flatnonzero(by)
    count = {name: int(by[at[at >> k & 1 == 1]].sum()) for k, name in enumerate(FLAGS)}
    near = 0
    hits = np.flatnonzero(seen & 0b100011)
    if len(hits) and count["second"]:
        second = np.flatnonzero(seen & 0b100)
        place = np.searchsorted(second, hits)
        gap = np.minimum(np.abs(hits - second[np.maximum(place - 1, 0)]), np.abs(hits - second[np.minimum(place, len(second) - 1)]))
        near = int((gap <= NEAR).sum())
    upper = len(text) - len(text.translate(_NO_CAPITALS))
    return [
        count["term"] / n, count["stem"] / n, count["term"], count["stem"], near / n, count["second"] / n, count["capitals"] / n,
        upper / len(text), count["exclaims"] / n, count["question"] / n, count["marks"] / n, count["obfuscated"] / n, count["hidden_term"] / n,
        count["stretched"] / n, float(np.log1p(n)), float(len(hits) > 0),
    ]


_NO_CAPITALS = {c: None for c in range(ord("A"), ord("Z") + 1)}
#: What a Python worker remembers of words, by the lexicon in use.
_FLAGS: dict[int, Flags] = {}


def _with_features(rows: DataFrame, lexicon: dict[int, frozenset], columns: list[str]) -> DataFrame:
    """Columns, and x array<double>: the features under the lexicon that the row's column `fold` names."""
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)  # LEXICON_SIZE terms at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other in _FLAGS.keys() - {hash(v) for v in sent.value.values()}:
            del _FLAGS[other]  # the words of a lexicon no longer in use
        memo = {k: _FLAGS.get(hash(v)) or _FLAGS.setdefault(hash(v), Flags(v)) for k, v in sent.value.items()}
        for batch in batches:
            x = [features(t, memo[f]) for t, f in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(x, pa.list_(pa.float64()))], names=[*columns, "x"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(run, f"{kinds}, x array<double>")


def _term_table(train: DataFrame) -> DataFrame:
    """(term, t0, c0, t1, c1): toxic and clean documents of either fold that hold a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter() for _ in range(4)]
        for batch in batches:
            for text, fold, label in zip(*(batch.column(c).to_pylist() for c in ("text", "fold", "label"))):
                seen[2 * fold + (label == 0)].update({t for w in set(text.split()) for t in terms(w)})
        every = sorted(set().union(*seen))
        counts = [pa.array([c[t] for t in every], pa.int64()) for c in seen]
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *counts], names=["term", "t0", "c0", "t1", "c1"])

    table = train.mapInArrow(run, "term string, t0 long, c0 long, t1 long, c1 long")
    return table.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("t0", "c0", "t1", "c1")])


def _lexicon(table: DataFrame, toxic: str, clean: str, n_toxic: int, n_clean: int) -> frozenset:
    rate = (F.col(toxic) + 0.5) / (n_toxic + 1.0)
    lift = rate / ((F.col(clean) + 0.5) / (n_clean + 1.0))
    best = table.where((F.col(toxic) >= LEXICON_DOCS) & (lift >= LEXICON_LIFT)).withColumn("gain", F.col(toxic) * F.log(lift))
    return frozenset(r.term for r in best.orderBy(F.desc("gain"), "term").limit(LEXICON_SIZE).select("term").collect())


class ToxicityModel:
    """Lexicon, boosted trees and calibration; trees is None where a class has no labels, and all scores are `prior`."""

    def __init__(self, lexicon: frozenset, trees, calibration, prior: float):
        self.lexicon, self.trees, self.calibration, self.prior = lexicon, trees, calibration, prior

    def score(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """columns and score, from rows with a column text."""
        if self.trees is None:
            return rows.select(*columns, F.lit(self.prior).alias("score"))
        x = _with_features(rows.withColumn("fold", F.lit(0)), {0: self.lexicon}, columns)
        raw = _probability(self.trees, x)
        score = self.calibration.transform(raw).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))))
        return score.select(*columns, "score")


def _probability(trees, x: DataFrame) -> DataFrame:
    out = trees.transform(x.withColumn("features", array_to_vector("x")))
    return out.withColumn("p", vector_to_array("probability")[1]).drop("features", "x", "rawPrediction", "probability", "prediction")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on the labelled documents that are not held out, a bounded sample of them.

    Each half of the sample gets the features of the lexicon learned on the other half, so that the trees
    see terms as they will see those of new documents. Trees learn on three quarters of the sample, the
    calibration on the rest; scores use the lexicon of the whole sample.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.where(~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(train_rows)
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    h = F.xxhash64(F.lit(11), "id")
    rows = texts.join(known, "id").withColumn("fold", F.pmod(h, F.lit(2)).cast("int")).withColumn("part", F.pmod(F.shiftright(h, 8), F.lit(4)))
    rows = shared_table(rows)
    sizes = {(r.fold, r.label): r.n for r in rows.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = (sum(n for (_, y), n in sizes.items() if y == want) for want in (1, 0))
    if not toxic or not clean:
        return ToxicityModel(frozenset(), None, None, toxic / max(1, toxic + clean))
    table = shared_table(_term_table(rows))
    at = lambda fold, label: sizes.get((fold, label), 0)
    other = {k: _lexicon(table, f"t{1 - k}", f"c{1 - k}", at(1 - k, 1), at(1 - k, 0)) for k in (0, 1)}
    both = table.select("term", (F.col("t0") + F.col("t1")).alias("t"), (F.col("c0") + F.col("c1")).alias("c"))
    lexicon = _lexicon(both, "t", "c", toxic, clean)
    x = _with_features(rows, other, ["id", "label", "part"])
    x = shared_table(x.withColumn("label", F.col("label").cast("double")).repartitionByRange(4, "id").sortWithinPartitions("id"))
    fit = x.where("part > 0")
    if fit.select("label").distinct().count() < 2:
        fit = x
    boosted = GBTClassifier(featuresCol="features", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.3, maxBins=64, seed=7)
    trees = boosted.fit(fit.withColumn("features", array_to_vector("x")).select("features", "label"))
    rest = _probability(trees, x.where("part = 0"))
    if rest.isEmpty():
        rest = _probability(trees, x)
    calibration = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="prediction").fit(rest)
    return ToxicityModel(lexicon, trees, calibration, toxic / (toxic + clean))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Score every whole text: (id_col, held_out, score, predicted), one row per input row.

    A document is held out if crc32 of its id as text is divisible by 5; its label is never learned. Null and
    empty texts have no words and get the calibrated score of that. A null id is not held out. Rows
    that repeat an id are scored each for itself; a document labelled twice has the larger label; labels
    that are null or neither 0 nor 1 are not used. Without labels of both classes all scores are the share
    of toxic ones. An empty table gives an empty result. Only the named columns are read.
    """
    model = train(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    scored = model.score(rows, ["id"])
    return scored.select(
        F.col("id").alias(id_col),
        F.coalesce(held_out("id"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
