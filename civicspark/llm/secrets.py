"""Secret scans: patterns of known kinds, and random strings told from identifiers by character Markov models."""

from __future__ import annotations

import bisect
import hashlib
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm.common import shared_table, text_or_empty

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A token that the models may judge; the characters are those that keys are written in.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

#: Characters of the models, which are those of tokens; all others, and both ends of a token, are one state more, which says nothing.
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/=_-"
STATES = len(ALPHABET) + 1
CODE = np.zeros(256, dtype=np.int64)
CODE[np.frombuffer(ALPHABET.encode(), dtype=np.uint8)] = np.arange(1, STATES)
_LOWER, _UPPER, _DIGIT, _MARK = np.arange(1, 27), np.arange(27, 53), np.arange(53, 63), np.arange(63, STATES)

#: A sample of random strings: how many of each alphabet are drawn, and of which lengths.
DRAWN, DRAWN_LENGTHS = 2000, (16, 49)
DRAWN_ALPHABETS = (
    "0123456789abcdef", "0123456789ABCDEF", string.ascii_lowercase + string.digits, string.ascii_uppercase + "234567",
    string.ascii_letters, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-",
)
#: Words that identifiers are made of: the fixed part of the labelled sample of identifiers.
PARTS = """access action address after api app array async auth back base batch block body bool buffer byte cache call cancel channel check child class
client close code color column config content context control copy count create current data date debug default delete device domain double edit
element empty encode entry error event exec exit export factory field file filter first flag folder font format frame function get global group handle
hash header height hex http icon image import index info init input insert item iterator job join json key kind label last layer length level list
load local log loop map match max merge message method mode model module mouse move name new next node null number object offset open option order
output page parent parse path pixel point pool proxy query queue quote range read record regex remove request reset result retry row run
save schema screen search select server session set shape size sort source stack start state status string style submit switch system table tag task
test text thread time title token trace tree type union unit update upper user value vector version video view visit wait width window word wrap
write xml year zip zone zoom"""
#: One text in HELD_OUT is held out of the models; all its words set the threshold, in groups of about GROUP. Their scores are counted in steps of STEP.
HELD_OUT, GROUP, STEP = 5, 20_000, 1e-3
#: Weight among identifiers of transitions between digits, of which numbers are made, and of a mark to itself, of which rules are made.
NUMBERS, RULES = 0.1, 0.02
#: Share of labelled identifiers that the threshold may let pass for random.
FALSE_SHARE = 1e-3


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern matches, leftmost and non-overlapping within each kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def secret_values(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What the pattern matches give away: the value of an assignment, else the match."""
    out = []
    for a, b, kind in spans:
        if kind == "assign":
            m = ASSIGN.match(text, a)
            out.append((m.start(2), m.end(2)))
        else:
            out.append((a, b))
    return out


def codes(text: str) -> np.ndarray:
    """A state for each code point."""
    return CODE[np.frombuffer(text.encode("latin-1", "replace").replace(b"?", b" "), dtype=np.uint8)]


def pairs(states: np.ndarray) -> np.ndarray:
    """Counts of neighbouring states, as one row."""
    return np.bincount(states[:-1] * STATES + states[1:], minlength=STATES * STATES)


def drawn_strings(seed: int = 1) -> list[str]:
    """Labelled random strings: uniform draws from the alphabets that keys are written in."""
    rng = np.random.default_rng(seed)
    out = []
    for letters in DRAWN_ALPHABETS:
        pool = np.array(list(letters))
        out += ["".join(pool[rng.integers(0, len(pool), n)]) for n in rng.integers(*DRAWN_LENGTHS, DRAWN)]
    return out


def joined_names(parts: list[str], seed: int = 1, each: int = 8) -> list[str]:
    """Labelled identifiers: words in twos to fours as snake_case, kebab-case, paths, camelCase, in capitals, unbroken, and with a number.

    Each word begins `each` of them.
    """
    rng = np.random.default_rng(seed)
    out = []
    for k in range(each * len(parts)):
        words = [parts[k % len(parts)], *[parts[i] for i in rng.integers(0, len(parts), 1 + k % 3)]]
        form = int(rng.integers(0, 8))
        low = [w.lower() for w in words]
        if form == 3:
            out.append(low[0] + "".join(w.capitalize() for w in low[1:]))
        elif form == 4:
            out.append("".join(w.capitalize() for w in low))
        elif form == 5:
            out.append("_".join(w.upper() for w in words))
        elif form == 6:
            out.append("_".join(low) + f"_{rng.integers(0, 10 ** int(rng.integers(1, 9)))}")
        else:
            out.append(("_", "-", "/")[form].join(words) if form < 3 else "".join(low))
    return out


def identifier_counts(written: np.ndarray) -> np.ndarray:
    """Transitions of identifiers made of the words that were counted: as written, in capitals, and as camelCase.

    Of a word that begins with a capital or follows another without a break the text itself has few, so
    capitals take the counts of their small letters, and a small letter is followed by a capital as often
    as a word of four letters ends, by whichever letter words begin with.
    """
    c = written.reshape(STATES, STATES).astype(np.float64)
    small = c[np.ix_(_LOWER, _LOWER)]
    total = small.sum()
    out = c.copy()
    out[0, :] = out[:, 0] = 0
    out[np.ix_(_UPPER, _UPPER)] += 0.1 * small
    out[np.ix_(_UPPER, _LOWER)] += 0.1 * small
    begins, ends = c[0, _LOWER] + c[0, _UPPER], c[_LOWER, 0]
    if total and begins.sum() and ends.sum():
        out[np.ix_(_LOWER, _UPPER)] += 0.025 * total * np.outer(ends / ends.sum(), begins / begins.sum())
    return (out / max(1.0, out.sum())).reshape(-1)


class MarkovPair:
    """Two first-order character models, of random strings and of identifiers, and the threshold between them.

    random and identifiers: counts of transitions, one row each; the rows fall back to how often a
    character occurs at all. threshold is a log-likelihood ratio per transition.
    """

    def __init__(self, random: np.ndarray, identifiers: np.ndarray, threshold: float = 1.0):
        def rows(counts: np.ndarray) -> np.ndarray:
            c = counts.reshape(STATES, STATES)[1:, 1:].astype(np.float64)
            single = c.sum(axis=0) + 0.5
            c = c + 5 * single / single.sum()
            return c / c.sum(axis=1, keepdims=True)

        self.ratio = np.zeros((STATES, STATES))
        self.ratio[1:, 1:] = np.log(rows(random)) - np.log(rows(identifiers))
        self.threshold = threshold

    def score(self, token: str) -> tuple[float, int]:
        """Log-likelihood ratio of the token's transitions (above zero: random is likelier), and their number."""
        s = codes(token)
        return float(self.ratio[s[:-1], s[1:]].sum()), int(((s[:-1] > 0) & (s[1:] > 0)).sum())

    def is_random(self, token: str) -> bool:
        ratio, n = self.score(token)
        return n > 0 and ratio > self.threshold * n

    def calibrate(self, identifiers: list[str], random: list[str]) -> None:
        """Set the threshold by labelled strings that the models have not seen.

        It lies in the middle between what all but FALSE_SHARE of the identifiers stay under and what one
        random string in a hundred stays under; if these cross, at the former, so that identifiers are left alone.
        """
        a = [x / n for x, n in map(self.score, identifiers) if n]
        self.set_threshold(float(np.quantile(a, 1 - FALSE_SHARE)) if a else 0.0, random)

    def set_threshold(self, high: float, random: list[str]) -> None:
        """Set the threshold by what all but FALSE_SHARE of the identifiers stay under, and random strings."""
        low = float(np.quantile([x / n for x, n in map(self.score, random) if n], 0.01))
        self.threshold = max(high, (high + low) / 2, 0.0)

    def steps(self, identifiers: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the tokens among identifiers per transition, as whole numbers of STEP rounded up, and how many have each."""
        scores = [x / n for x, n in map(self.score, filter(TOKEN.fullmatch, identifiers)) if n]
        return np.unique(np.ceil(np.array(scores) / STEP).astype(np.int64), return_counts=True)


def held_out_score(words: DataFrame, models: MarkovPair) -> float:
    """What all but FALSE_SHARE of labelled identifiers score at most, to a STEP: joined names that each of the distinct words begins, and of PARTS.

    Words join those of their group, which their hashes tell; tasks count scores, and only the counts, as many as there are steps, come to the driver.
    """
    table = shared_table(words.select("word"))
    groups = max(1, -(-table.count() // GROUP))

    def count(group: tuple, held: pa.Table) -> pa.Table:
        steps, n = models.steps(joined_names(sorted(held["word"].to_pylist()), seed=2 + group[0].as_py(), each=2))
        return pa.table({"step": pa.array(steps, pa.int64()), "n": pa.array(n, pa.int64())})

    counted = table.withColumn("of", F.pmod(F.xxhash64("word"), F.lit(groups))).groupBy("of").applyInArrow(count, "step long, n long")
    found = {r.step: r.n for r in counted.groupBy("step").agg(F.sum("n").alias("n")).collect()}
    for step, n in zip(*models.steps(joined_names(PARTS.split(), seed=3, each=40))):
        found[int(step)] = found.get(int(step), 0) + int(n)
    order = sorted(found)
    least = (1 - FALSE_SHARE) * sum(found.values())
    return order[int(np.searchsorted(np.cumsum([found[s] for s in order]), least))] * STEP


def tokens(text: str, base: list[tuple[int, int, str]]) -> Iterator[re.Match]:
    """Tokens that no pattern match touches."""
    starts, ends = [], []  # of the stretches that matches cover
    for a, b, _ in sorted(base):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for m in TOKEN.finditer(text):
        k = bisect.bisect_left(starts, m.end())
        if not k or ends[k - 1] <= m.start():
            yield m


def random_spans(text: str, base: list[tuple[int, int, str]], models: MarkovPair) -> list[tuple[int, int, str]]:
    """Tokens that read as random and that no pattern match touches."""
    return [(m.start(), m.end(), "random") for m in tokens(text, base) if models.is_random(m.group())]


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def _is_held_out(text: str) -> bool:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=4).digest()) % HELD_OUT == 0


#: A word of a text that is shorter than any token.
SHORT = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{3,15}(?![A-Za-z0-9+/_=-])")


def train(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> MarkovPair:
    """Fit both models on labelled samples, and calibrate them on texts held out.

    Random: the values that patterns find, and drawn_strings(), half and half. Identifiers: the words of
    all documents that are shorter than a token, and joined_names() of PARTS, half and half, with what
    identifier_counts() makes of them, and shares for numbers and rules. Tokens, which are what the models judge, are
    counted on neither side: keys in the documents, however many, change neither the models nor the threshold.
    A task counts its own transitions; only the counts, as many as there are pairs of characters, are
    summed and brought to the driver. One text in HELD_OUT is not counted: joined names of all its words
    and of PARTS, and strings drawn anew, set the threshold.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random, ordinary = np.zeros(STATES * STATES, dtype=np.int64), np.zeros(STATES * STATES, dtype=np.int64)
        for batch in batches:
            kept: set[str] = set()
            for text in batch.column(0).to_pylist():
                if len(text) < 2:
                    continue
                base = base_spans(text)
                states = codes(text)
                values = sorted(set(secret_values(text, base)))
                for a, b in values:
                    random += pairs(states[a:b]) if b - a > 1 else 0
                if _is_held_out(text):
                    kept.update(m.group() for m in SHORT.finditer(text))
                    continue
                for a, b in values + [m.span() for m in TOKEN.finditer(text)]:
                    states[a:b] = 0
                ordinary += pairs(states)
            held = sorted(kept)
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.string()), *[pa.array([None] * len(held), pa.int64()) for _ in range(3)]], names=["word", "k", "random", "ordinary"]
            )
        k = np.flatnonzero(random + ordinary)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None] * len(k), pa.string()), *[pa.array(x) for x in (k, random[k], ordinary[k])]], names=["word", "k", "random", "ordinary"]
        )

    counted = shared_table(docs.select(text_or_empty(text_col).alias("text")).mapInArrow(count, "word string, k long, random long, ordinary long"))
    table = np.zeros((2, STATES * STATES), dtype=np.int64)
    for r in counted.where("k is not null").groupBy("k").agg(F.sum("random").alias("random"), F.sum("ordinary").alias("ordinary")).collect():
        table[:, r.k] = r.random, r.ordinary
    found, drawn = table[0].astype(np.float64), sum(pairs(codes(s)) for s in drawn_strings())
    random = drawn / drawn.sum() + found / max(1.0, found.sum())
    known = sum(pairs(codes(f" {n} ")) for n in joined_names(PARTS.split()))
    single = np.zeros((STATES, STATES))
    single[np.ix_(_DIGIT, _DIGIT)] = NUMBERS / 100  # any digit follows any
    single[_MARK, _MARK] = RULES / len(_MARK)
    ordinary = identifier_counts(table[1]) + identifier_counts(known) + single.reshape(-1)
    models = MarkovPair(random * drawn.sum(), ordinary * drawn.sum())
    models.set_threshold(held_out_score(counted.where("word is not null").select("word").distinct(), models), drawn_strings(seed=2))
    return models


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", models: MarkovPair | None = None) -> DataFrame:
    """Find secrets in every whole text.

    Returns (id_col, base, spans), one row per input row: arrays of (kind, start, end) in code points, end
    exclusive, by start and then kind: the pattern matches, and all of them with what the models add. Null
    and empty texts have no spans. Ids may be null or repeat; rows are independent once the models are
    trained. An empty table gives an empty result. Only the two named columns are read.
    """
    models = models or train(docs.sparkSession, docs, text_col)
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, every = [], []
            for text in batch.column(1).to_pylist():
                known = base_spans(text)
                found = in_order(known + random_spans(text, known, models))
                some.append([{"kind": k, "start": a, "end": b} for a, b, k in in_order(known)])
                every.append([{"kind": k, "start": a, "end": b} for a, b, k in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(some, span), pa.array(every, span)], names=["id", "base", "spans"])

    kind = base.schema["id"].dataType.simpleString()
    each = "array<struct<kind:string,start:bigint,end:bigint>>"
    return base.mapInArrow(scan, f"id {kind}, base {each}, spans {each}").withColumnRenamed("id", id_col)


def digest(spans: list[tuple[int, int, str]]) -> str:
    """SHA-256 of kind:start:end, comma-joined."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in in_order(spans)).encode()).hexdigest()
