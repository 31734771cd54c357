"""Quality classifier from weak labels: expectation-maximisation over heuristics trains a hashed linear scorer."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import numbered, shared_table, text_or_empty

BAD, GOOD, NONE = 0, 1, 2
#: Documents whose features train the scorer: those with the smallest hash of id and text.
TRAIN_ROWS = 5000
#: Hashed features; a power of two.
BUCKETS = 1 << 18
#: Words whose flags and buckets a Python worker remembers; past it the memory starts anew. Longer words are not remembered.
MEMO, MEMO_CHARS = 600_000, 64
#: Distinct features of the training rows together; a row that would exceed them is passed over.
TRAIN_FEATURES = 4_000_000

SYMBOL = re.compile(r"[#*$%&|<>@^~=+{}\\]")
TRAILING = re.compile(r"[^\w\s.,;:!?\"'()\[\]-]{2,}$|^[^\w\s]$")
#: Frequent function words of the languages in the corpus.
FUNCTION_WORDS = frozenset(
    """the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all
    der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer
    le la les de des et un une du en que qui dans pour par sur au est il elle on ne pas plus avec ce se son sa ses ou où
    el los las y del se por un una con para su al lo como más pero sus le ya o este sí porque esta entre""".split()
)


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) & (BUCKETS - 1)


class _Kinds(dict):
    """Code point -> a or A for letters, 0 for digits, itself for others."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = got = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return got


_KINDS, _RUN = _Kinds(), re.compile(r"(.)\1+", re.DOTALL)


def shape(word: str) -> str:
    """The word with letters as a or A and digits as 0, runs of one kind as one character."""
    return _RUN.sub(r"\1", word.translate(_KINDS))


#: What a word tells the labellers, one bit each.
FLAGS = ("symbol", "capitals", "function", "sentence_end", "emphatic", "no_letter", "trailing")


class Words(dict):
    """word -> its flags, the bucket of the word and the bucket of its shape in one number, learned as words are met."""

    def __missing__(self, word: str) -> int:
        if word.isalpha() and word.islower():
            low, flags, s = word, (word in FUNCTION_WORDS) << 2, "a"
        else:
            bare = word.strip(".,;:!?\"'()")
            low, s = bare.lower(), shape(word)
            flags = (
                bool(SYMBOL.search(word))
                | (len(bare) > 1 and bare.isupper()) << 1
                | (low in FUNCTION_WORDS) << 2
                | (word[-1] in ".,;:!?") << 3
                | word.endswith(("!!", "??", "?!", "!?")) << 4
                | ("a" not in s and "A" not in s) << 5
                | bool(TRAILING.search(word)) << 6
            )
        got = flags | _hash("w " + low) << 8 | _hash("s " + s) << 32
        if len(word) <= MEMO_CHARS:
            self[word] = got
        return got


_WORDS = Words()


def read(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(flags, word bucket, shape bucket) of each word, and the mean length of a word."""
    if len(_WORDS) > MEMO:
        _WORDS.clear()
    found = text.split()
    seen = np.fromiter(map(_WORDS.__getitem__, found), dtype=np.int64, count=len(found))
    return seen & 255, seen >> 8 & 0xFFFFFF, seen >> 32, sum(map(len, found)) / max(1, len(found))


#: The labellers, in the order of votes().
LABELLERS = ("symbols", "trailing_marks", "capitals", "function_words", "punctuation", "emphasis", "no_letters", "stutter", "variety", "length", "word_length")


def votes(flags: np.ndarray, words: np.ndarray, shapes: np.ndarray, length: float) -> list[int]:
    """The vote of each labeller on a document.

    Thresholds leave a middle in which a labeller abstains. All abstain on fewer than ten words, and on
    fewer than twenty none calls a document bad for what it lacks.
    """
    n = len(words)
    if n < 10:
        return [NONE] * len(LABELLERS)
    counts = np.bincount(flags, minlength=128)
    share = {name: counts[np.arange(len(counts)) >> k & 1 == 1].sum() / n for k, name in enumerate(FLAGS)}
    stutter = (words[1:] == words[:-1]).sum() / n
    top = np.unique(words, return_counts=True)[1]
    variety = len(top) / min(n, 200) if n < 200 else len(top) / (200 * (n / 200) ** 0.6)
    many = n >= 20

    def v(bad: bool, good: bool) -> int:
        return BAD if bad else GOOD if good else NONE

    return [
        v(share["symbol"] > 0.1, share["symbol"] < 0.02),
        v(share["trailing"] > 0.1, share["trailing"] < 0.02),
        v(share["capitals"] > 0.2, share["capitals"] < 0.05),
        v(many and share["function"] < 0.02, share["function"] > 0.08),
        v(many and not 0.01 <= share["sentence_end"] <= 0.5, 0.03 < share["sentence_end"] < 0.35),
        v(share["emphatic"] > 0.1, share["emphatic"] < 0.02),
        v(many and share["no_letter"] > 0.25, share["no_letter"] < 0.05),
        v(stutter > 0.15, stutter < 0.04),
        v(many and (variety < 0.2 or top.max() > 0.4 * n), variety > 0.35 and top.max() < 0.2 * n),
        v(False, n >= 30),
        v(many and not 2.5 <= length <= 14, 3.5 < length < 9),
    ]


@dataclass
class LabelModel:
    """Class prior and, for each labeller, the chances of its votes given the class; to abstain says nothing."""

    prior: np.ndarray  # [2]
    chance: np.ndarray  # [labeller, class, vote]; 1 for NONE

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good) of each row of votes."""
        log_p = np.log(self.prior)[None, :] + sum(np.log(self.chance[k][:, patterns[:, k]]).T for k in range(patterns.shape[1]))
        return 1 / (1 + np.exp(np.clip(log_p[:, BAD] - log_p[:, GOOD], -500, 500)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-7) -> LabelModel:
    """Estimate how reliable each labeller is from their overlaps alone.

    patterns: distinct rows of votes, with how many documents have them. Starts from the belief that one
    vote for bad outweighs votes for good, since each labeller knows its own kind of bad document.
    """
    n_votes = patterns.shape[1]
    bad = (patterns == BAD).sum(axis=1)
    good = np.where(bad == 0, 0.95, np.where(bad == 1, 0.3, 0.05))
    one_hot = np.stack([patterns == v for v in (BAD, GOOD)], axis=2).astype(np.float64)
    model = None
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        chance = np.einsum("cp,pkv->kcv", weight, one_hot) + 1.0
        chance = np.concatenate([chance / chance.sum(axis=2, keepdims=True), np.ones((n_votes, 2, 1))], axis=2)
        model = LabelModel((weight.sum(axis=1) + 1) / (weight.sum() + 2), chance)
        new = model.posterior(patterns)
        if np.abs(new - good).max() < tolerance:
            break
        good = new
    return model


def features(words: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values): square roots of the shares of words, shapes and stuttered words; the norm is one."""
    same = words[1:] == words[:-1]
    marks = np.where(same, _SAME, _OTHER)
    buckets = np.concatenate([words, shapes, shapes, marks, marks])
    at, n = np.unique(buckets, return_counts=True)
    return at, np.sqrt(n / max(1, len(buckets)))


_SAME, _OTHER = _hash("p same"), _hash("p other")


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = 12, rate: float = 1.0, ridge: float = 1e-6, seed: int = 0):
    """Weights [BUCKETS + 1] of a logistic regression on soft labels, by AdaGrad; the last is the bias."""
    w, g = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x + w[-1], -30, 30)))
            slope = (p - target[i]) * x + ridge * w[at]
            g[at] += slope * slope
            w[at] -= rate * slope / np.sqrt(g[at])
            g[-1] += (p - target[i]) ** 2
            w[-1] -= 0.1 * rate * (p - target[i]) / np.sqrt(g[-1])
    return w.astype(np.float32)


def _vote_table(base: DataFrame) -> DataFrame:
    """(pattern, n): how many documents have each pattern of votes, as a number in base 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [sum(v * 3**k for k, v in enumerate(votes(*read(t)))) for t in batch.column(0).to_pylist()]
            at, n = np.unique(np.array(codes, dtype=np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.astype(np.int64))], names=["pattern", "n"])

    return base.select("text").mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def _training_rows(sample: DataFrame) -> DataFrame:
    """(h, n, at, x, votes) of sample (h, text): n distinct features, their buckets and values, and the votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x, v = [], [], []
            for text in batch.column(1).to_pylist():
                seen = read(text)
                a, b = features(seen[1], seen[2])
                at.append(a.astype("<i4").tobytes())
                x.append(b.astype("<f4").tobytes())
                v.append(votes(*seen))
            n = pa.array([len(a) // 4 for a in at], pa.int64())
            data = [batch.column(0), n, pa.array(at, pa.binary()), pa.array(x, pa.binary()), pa.array(v, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(data, names=["h", "n", "at", "x", "votes"])

    return sample.mapInArrow(run, "h long, n long, at binary, x binary, votes array<int>")


def _within(sizes: list[tuple[int, int]], most: int) -> list[int]:
    """The first of (key, size), by key, that together have `most` at most; those too large for what is left are passed over."""
    out, used = [], 0
    for h, n in sorted(sizes):
        if used + n <= most:
            out.append(h)
            used += n
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> tuple[LabelModel, np.ndarray]:
    """Fit the label model on the votes over all documents, then the scorer on a bounded sample of them."""
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    table = _vote_table(base).collect()  # as many rows as there are patterns of votes that occur
    if not table:
        return LabelModel(np.array([0.5, 0.5]), np.ones((len(LABELLERS), 2, 3))), np.zeros(BUCKETS + 1, dtype=np.float32)
    codes = np.array([r.pattern for r in table], dtype=np.int64)
    patterns = np.stack([codes // 3**k % 3 for k in range(len(LABELLERS))], axis=1)
    labels = fit_labels(patterns, np.array([r.n for r in table], dtype=np.float64))
    hashed = base.withColumn("h", F.xxhash64("id", "text"))
    # the smallest hashes first, then the texts they belong to: no other text is shuffled
    last = hashed.select("h").orderBy("h").limit(train_rows).agg(F.max("h").alias("h")).first().h
    chosen = hashed.where(F.col("h") <= last).dropDuplicates(["h"]).select("h", "text")
    sample = shared_table(_training_rows(chosen))
    fit = _within([tuple(r) for r in sample.select("h", "n").collect()], TRAIN_FEATURES)
    rows = sample.where(F.col("h").isin(fit)).drop("h").collect()  # TRAIN_FEATURES features at most, however long the texts
    data = [(np.frombuffer(r.at, "<i4").astype(np.int64), np.frombuffer(r.x, "<f4").astype(np.float64)) for r in rows]
    target = labels.posterior(np.array([r.votes for r in rows], dtype=np.int64))
    order = sorted(range(len(rows)), key=lambda i: (rows[i].at, rows[i].x))  # the same whatever the partitions
    return labels, fit_scorer([data[i] for i in order], target[order])


def _scores(texts: list[str], w: np.ndarray) -> list[float]:
    out = []
    for text in texts:
        _, words, shapes, _ = read(text)
        at, x = features(words, shapes)
        out.append(1 / (1 + float(np.exp(-np.clip(w[at] @ x + w[-1], -30, 30)))) if len(words) else 0.0)
    return out


def good_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, whatever these are called, that quality_scores() keeps. No row is shuffled for it.

    Null and empty texts go; nulls elsewhere, null ids and repeated rows are kept as they are; an empty table stays empty.
    """
    rows, (key, text) = numbered(docs, id_col, text_col)
    _, weights = train(rows, key, text, train_rows)
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["" if t is None else str(t) for t in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(np.array(_scores(texts, sent.value)) >= threshold, pa.bool_()))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Score every document; (id_col, __th, score, kept), one row per input row.

    score is the linear scorer's P(good) and kept tells that it reaches the threshold; __th is the hash of
    the text. Null and empty texts have no words, are bad and score 0. Null and repeated ids are
    scored like others. An empty table gives an empty result. Only the two named columns are read.
    """
    _, weights = train(docs, id_col, text_col, train_rows)
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    base = base.select("id", F.xxhash64("text").alias("__th"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            scores = _scores(batch.column(2).to_pylist(), w)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["id", "__th", "score"])

    kind = base.schema["id"].dataType.simpleString()
    out = base.mapInArrow(run, f"id {kind}, __th long, score double")
    return out.select(F.col("id").alias(id_col), "__th", "score", (F.col("score") >= threshold).alias("kept"))
