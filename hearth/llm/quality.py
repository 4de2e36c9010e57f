"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or abstain on every text. Votes of all
documents are counted by pattern; expectation-maximisation over the patterns
estimates how often each heuristic votes which way on good and on bad texts, and
so the probability that a text with a pattern is good. Bad texts are of several kinds
that fail different heuristics, so false alarms are bounded by ``MOST_FALSE``: one
kind cannot be explained away as errors on good texts. These posterior labels
train a linear scorer over hashed word shapes and text statistics by gradient
descent, on a bounded sample of about ``SAMPLE`` rows of either kind. The scorer,
not the votes, decides; what it scores below ``THRESHOLD`` is rejected.

A null or empty text, or one without words, has nothing to be judged by: score
0.5, kept. Repeated rows are scored alike. No label of any table is used.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.llm.common import append_columns, written

BUCKETS = 1 << 14
SAMPLE = 3000
THRESHOLD = 0.2  # the two kinds weigh the same in training, so this favours keeping
ROUNDS = 60
MOST_FALSE = 0.01  # share of its votes in which a heuristic may call a good text bad
EPOCHS = 6
ABSTAIN, BAD, GOOD = 0, 1, 2

# name, bad if below / above, good if between: fixed limits of the heuristics
LIMITS = [
    ("symbol_words", None, 0.10, 0.0, 0.02),
    ("symbol_chars", None, 0.10, 0.0, 0.06),
    ("clean_words", 0.60, None, 0.90, 1.0),
    ("bare_marks", None, 0.12, 0.0, 0.02),
    ("shouting_words", None, 0.20, 0.0, 0.03),
    ("upper_letters", None, 0.50, 0.0, 0.20),
    ("upper_words", None, 0.50, 0.0, 0.10),
    ("distinct_words", 0.15, None, 0.30, 1.0),
    ("distinct_pairs", 0.25, None, 0.60, 1.0),
    ("adjacent_repeats", None, 0.20, 0.0, 0.04),
    ("top_word", None, 0.45, 0.0, 0.20),
    ("mean_length", 2.0, 14.0, 3.0, 9.0),
]

# every byte as its kind: letters A and a, digits 0, symbols *, exclamation !, other marks a full stop
KINDS = bytes(
    b if b in b" \t\n\r\x0b\x0c" else 65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57
    else 42 if b in b"*%$#&|~^=<>_{}[]\\" else 33 if b == 33 else 46
    for b in range(256)
)
CLEAN = re.compile(rb"[Aa0]+(?:\.[Aa0]+)*[.!]?")
RUNS = re.compile(rb"(.)\1+", re.S)


class _Shapes(dict):
    """What is counted of a word by its shape; shapes are few, and forgotten when they are not."""

    def __missing__(self, shape: bytes) -> tuple:
        if len(self) > 50_000:
            self.clear()
        upper, lower, digits = shape.count(b"A"), shape.count(b"a"), shape.count(b"0")
        marked, size = b"*" in shape, len(shape)
        short = RUNS.sub(rb"\1", shape)[:4]
        self[shape] = out = (
            marked, size - upper - lower - digits, CLEAN.fullmatch(shape) is not None, not upper + lower + digits,
            shape.count(b"!") > 1, upper, upper > 1 and not lower, upper + lower, size, xxhash.xxh3_64_intdigest(short) % BUCKETS,
        )
        return out


SHAPES = _Shapes()


def statistics(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """One number per heuristic; buckets of the words' shapes and the share of each. None without words."""
    words = text.split()
    if not words:
        return None
    n, count = len(words), Counter(words)
    shapes = Counter(text.translate(KINDS).split())
    table = np.array([SHAPES[shape] for shape in shapes], dtype=float)
    times = np.fromiter(shapes.values(), float, len(shapes))
    marked, marks, clean, bare, shouting, upper, upper_words, letters, size = (times @ table[:, :9]).tolist()
    pairs = n - 1
    adjacent = sum(map(operator.eq, words, words[1:]))
    long = n >= 20
    values = [
        marked / n, marks / size, clean / n, bare / n, shouting / n, upper / max(1.0, letters), upper_words / n,
        len(count) / n if long else 1.0, len(set(zip(words, words[1:], strict=False))) / pairs if long else 1.0,
        adjacent / max(1, pairs), max(count.values()) / n if long else 0.0, size / n,
    ]
    return np.array(values), table[:, 9].astype(np.int64), times / n


def votes(values: np.ndarray) -> int:
    """The votes of all heuristics as one number in base three."""
    pattern = 0
    for value, (_, low, high, good_low, good_high) in zip(values.tolist(), LIMITS, strict=True):
        vote = ABSTAIN
        if (low is not None and value < low) or (high is not None and value > high):
            vote = BAD
        elif good_low <= value <= good_high:
            vote = GOOD
        pattern = pattern * 3 + vote
    return pattern


def expectation_maximisation(counts: dict[int, int]) -> dict[int, float]:
    """Probability of good for every vote pattern, from how often the patterns occur."""
    if not counts:
        return {}
    patterns = np.array(sorted(counts))
    weight = np.array([counts[p] for p in patterns.tolist()], dtype=float)
    base = 3 ** np.arange(len(LIMITS) - 1, -1, -1)
    table = patterns[:, None] // base % 3
    good = np.clip(0.5 + 0.5 * ((table == GOOD).sum(axis=1) - 3 * (table == BAD).sum(axis=1)) / len(LIMITS), 0.02, 0.98)
    for _ in range(ROUNDS):
        prior = np.clip((weight @ good) / weight.sum(), 1e-4, 1 - 1e-4)
        score = np.full(len(patterns), np.log(prior / (1 - prior)))
        for k in range(len(LIMITS)):
            for vote in (BAD, GOOD):  # an abstention says nothing
                own = table[:, k] == vote
                voted = table[:, k] != ABSTAIN
                rate = [(weight[own] @ side[own] + 1) / (weight[voted] @ side[voted] + 2) for side in (good, 1 - good)]
                rate[0] = min(rate[0], MOST_FALSE) if vote == BAD else rate[0]
                score[own] += np.log(rate[0] / rate[1])
        good = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return dict(zip(patterns.tolist(), good.tolist(), strict=True))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and weights: shares of hashed word shapes, and the statistics in steps."""
    found = statistics(text)
    if found is None:
        return None
    values, at, share = found
    steps = np.where([name == "mean_length" for name, *_ in LIMITS], np.minimum(values, 20.0), values * 20).astype(np.int64)
    return np.concatenate((at, [STEPS[k, v] for k, v in enumerate(steps.tolist())])), np.concatenate((share, np.full(len(LIMITS), 0.5)))


STEPS = {(k, v): xxhash.xxh3_64_intdigest(f"{name}={v}".encode()) % BUCKETS for k, (name, *_) in enumerate(LIMITS) for v in range(21)}


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        found = features(text)
        if found is None:
            return 0.5
        return float(1 / (1 + np.exp(-(found[1] @ self.weights[found[0]] + self.bias))))


def train(rows: list[tuple[float, np.ndarray, np.ndarray]], seed: int = 5) -> Scorer:
    """Logistic regression on soft labels; both kinds weigh the same."""
    weights, bias = np.zeros(BUCKETS), 0.0
    good = sum(p for p, *_ in rows)
    bad = len(rows) - good
    if not rows or good < 1e-3 or bad < 1e-3:
        return Scorer(weights, 10.0 if good >= bad else -10.0)
    rng = np.random.default_rng(seed)
    squares = np.full(BUCKETS, 1e-2)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            p, at, x = rows[i]
            guess = 1 / (1 + np.exp(-np.clip(x @ weights[at] + bias, -30, 30)))
            slope = (p * (guess - 1) / good + (1 - p) * guess / bad) * len(rows) / 2
            pull = slope * x
            np.add.at(squares, at, pull**2)
            np.add.at(weights, at, -0.3 * pull / np.sqrt(squares[at]))
            bias -= 0.02 * slope
    return Scorer(weights, bias)


def fit(docs: DataFrame, text_col: str = "text") -> Scorer:
    """Count votes over all rows, estimate the heuristics, and train the scorer on posterior labels."""
    spark = docs.sparkSession
    keyed = docs.select(F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text"))

    def vote(texts: list[bytes]) -> list[pa.Array]:
        found = [statistics(t) for t in texts]
        return [pa.array([None if f is None else votes(f[0]) for f in found], pa.int64())]

    cast = written(append_columns(keyed, "text", vote, [("pattern", T.LongType())]).where("pattern IS NOT NULL").select("key", "pattern"), "votes")
    counts = {r.pattern: r["count"] for r in cast.groupBy("pattern").count().collect()}  # at most 3 ** len(LIMITS) patterns
    good = expectation_maximisation(counts)
    n_good = sum(c for p, c in counts.items() if good[p] >= 0.5)
    n_bad = sum(counts.values()) - n_good
    shares = {p: min(1.0, SAMPLE / max(1, n_good if g >= 0.5 else n_bad)) for p, g in good.items()}
    if not good:
        return Scorer(np.zeros(BUCKETS), 10.0)
    table = spark.createDataFrame([(p, good[p], shares[p]) for p in sorted(good)], "pattern long, good double, share double")
    draw = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    keys = cast.join(F.broadcast(table), "pattern").where(draw < F.col("share")).groupBy("key").agg(F.first("good").alias("good"))
    keys = keys.orderBy(F.xxhash64("key")).limit(4 * SAMPLE)
    chosen = keyed.join(F.broadcast(keys), "key").dropDuplicates(["key"])

    def expand(texts: list[bytes]) -> list[pa.Array]:
        found = [features(t) for t in texts]
        return [pa.array([f[0].astype("<i4").tobytes() for f in found], pa.binary()), pa.array([f[1].astype("<f4").tobytes() for f in found], pa.binary())]

    got = append_columns(chosen, "text", expand, [("at", T.BinaryType()), ("x", T.BinaryType())]).select("key", "good", "at", "x").orderBy("key")
    return train([(r.good, np.frombuffer(r.at, "<i4"), np.frombuffer(r.x, "<f4").astype(float)) for r in got.toLocalIterator()])


def judge(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """``docs`` and quality (probability of good), kept."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # one number per bucket, whatever the input

    def compute(texts: list[bytes]) -> list[pa.Array]:
        scores = [shared.value.score(t) for t in texts]
        return [pa.array(scores, pa.float64()), pa.array([s >= THRESHOLD for s in scores], pa.bool_())]

    return append_columns(docs, text_col, compute, [("quality", T.DoubleType()), ("kept", T.BooleanType())])
