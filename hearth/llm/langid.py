"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's subwords are the letter n-grams of its words, with word edges, hashed
into buckets. The mean of their embeddings goes through a linear softmax. Both
are trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows, of up to ``PER_LANGUAGE`` expected rows of each language; one part
of the sample is held out to fit the temperature of the softmax.

A prediction is rejected where the text's subwords are strange to all languages,
so that a text of several learnt languages stays. A subword's surprise is the
least that any language's sample gives it; the mean over the text is put in units
of the deviation that held-out texts of its length show, in the language where
it is least strange. The limit lies halfway between
what ``COVERAGE`` of the held-out texts stay below and what all but
``STRANGERS`` of known strangers exceed: every held-out text judged as if its own
language had not been learnt, and with its letters shuffled. Where the two
overlap, the held-out texts decide. Texts of a few words can be too short for a
rejection.

Whole texts are read, in slices that lose no n-gram. A null text, or one without a letter, is ``und`` with score 0 and rejected. Rows
without a label are predicted but not learnt from. Without any labelled row,
every text is ``und``. Ties go to the language first in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.llm.common import append_columns

UNKNOWN = "und"
BUCKET_BITS = 15
DIMENSIONS = 16
SIZES = (1, 2, 3)
PER_LANGUAGE = 800
EPOCHS = 4
RATE = 4.0
COVERAGE = 0.999
STRANGERS = 0.02
SMOOTHING = 0.1
SLICE = 1 << 20
PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def subword_slices(text: str) -> Iterator[np.ndarray]:
    """Buckets of all letter n-grams of a text's words, those that start within a slice at a time."""
    padded = f"\0{text.lower()}\0"
    for low in range(0, len(padded), SLICE):
        codes = np.frombuffer(padded[low : low + SLICE + max(SIZES) - 1].encode("utf-32-le"), dtype="<u4")
        letter = letter_table()[codes]
        codes = np.where(letter, codes, 0).astype(np.uint32)
        parts = []
        for n in SIZES:
            starts = max(0, min(SLICE, len(codes) - n + 1))
            mixed = np.full(starts, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                mixed = (mixed ^ codes[k : k + starts]) * PRIMES[k]
                mixed ^= mixed >> np.uint32(15)
            if n == 2:
                valid = letter[:starts] | letter[1 : 1 + starts]
            else:  # an edge can stand at either end of three only
                valid = letter[n // 2 : n // 2 + starts]
            parts.append(mixed[valid] >> np.uint32(32 - BUCKET_BITS))
        yield np.concatenate(parts).astype(np.int64)


def bucket_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for found in subword_slices(text):
        counts += np.bincount(found, minlength=len(counts))
    found = np.flatnonzero(counts)
    return found, counts[found]


def shuffled(text: str) -> str:
    """The text with its letters dealt anew to the places of letters."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").copy()
    places = np.flatnonzero(letter_table()[codes])
    codes[places] = codes[np.random.default_rng(len(places)).permutation(places)]
    return codes.tobytes().decode("utf-32-le")


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    """Scores of every bucket by language, its surprise, the temperature's inverse, and what is usual.

    ``usual`` holds for every language the mean surprise of a text and the two
    parts of its variance: between texts, and shrinking with the number of subwords.
    """

    languages: list[str]
    table: np.ndarray
    surprise: np.ndarray
    sharpness: float
    usual: np.ndarray
    limit: float

    def strangeness(self, mean: float, n: int, but: int = -1) -> float:
        """Deviations above what is usual in the language, other than ``but``, where the text is least strange."""
        usual = np.delete(self.usual, but, axis=0) if but >= 0 else self.usual
        return float(((mean - usual[:, 0]) / np.sqrt(usual[:, 1] + usual[:, 2] / n + 1e-12)).min())

    def predict(self, text: str) -> tuple[str, float, bool]:
        total, odd, n = np.zeros(len(self.languages)), 0.0, 0
        for found in subword_slices(text):
            total += self.table[found].sum(axis=0)
            odd += float(self.surprise[found].sum())
            n += len(found)
        if not n or not self.languages:
            return UNKNOWN, 0.0, False
        p = _softmax(total / n * self.sharpness)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), self.strangeness(odd / n, n) <= self.limit


def _usual(means: np.ndarray, sizes: np.ndarray) -> tuple[float, float, float]:
    """Centre of the mean surprises, variance between texts, and variance times the number of subwords."""
    if not len(means):
        return 0.0, 1.0, 0.0
    centre = float(np.average(means, weights=np.sqrt(sizes)))
    square, inverse = (means - centre) ** 2, 1 / sizes
    # both parts are fitted to the squares relative to their own size, so that short texts do not decide alone
    parts = np.stack((np.ones(len(sizes)), inverse), axis=1)
    weight = 1 / (inverse + inverse.mean())
    within, between = 0.0, float(square.mean())
    if len(sizes) > 1:
        between, within = np.linalg.lstsq(parts * weight[:, None], square * weight, rcond=None)[0]
        if between < 0:
            between, within = 0.0, float((square * weight**2 * inverse).sum() / ((weight * inverse) ** 2).sum())
        elif within < 0:
            between, within = float(np.average(square, weights=weight**2)), 0.0
    return centre, float(between), float(within)


Row = tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def train(rows: list[Row], seed: int = 7) -> Model:
    """Fit on (language, buckets, counts, the same of its shuffled text); every fifth row is held out for calibration."""
    rows = [r for r in rows if len(r[1])]
    languages = sorted({r[0] for r in rows})
    n = 1 << BUCKET_BITS
    if not languages:
        return Model([], np.zeros((n, 0)), np.zeros(n), 1.0, np.zeros((0, 3)), 0.0)
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (n, DIMENSIONS))
    weights = rng.normal(0, 0.1, (DIMENSIONS, len(languages)))
    held, used = rows[::5], [r for i, r in enumerate(rows) if i % 5] or rows
    steps = EPOCHS * len(used)
    for step, i in enumerate(i for _ in range(EPOCHS) for i in rng.permutation(len(used))):
        language, buckets, counts = used[i][:3]
        share = counts / counts.sum()
        rate = RATE * (1 - step / steps)
        mean = share @ embed[buckets]
        slope = _softmax(mean @ weights)
        slope[languages.index(language)] -= 1
        back = weights @ slope
        weights -= rate * 0.1 * np.outer(mean, slope)
        embed[buckets] -= rate * share[:, None] * back
    table = embed @ weights
    seen = np.full((n, len(languages)), SMOOTHING)
    for language, buckets, counts, *_ in used:
        seen[buckets, languages.index(language)] += counts
    by_language = -np.log(seen / seen.sum(axis=0))
    surprise = by_language.min(axis=1)

    def average(of: np.ndarray, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.array([(c / c.sum()) @ of[b] for b, c in texts])

    own = [(r[1], r[2]) for r in held]
    logits = average(table, own)
    truth = np.array([languages.index(r[0]) for r in held])
    places, sizes = np.arange(len(held)), np.array([r[2].sum() for r in held])
    grid = 2.0 ** np.arange(-4, 6.5, 0.5)
    loss = [-np.log(_softmax(logits * s)[places, truth] + 1e-12).mean() for s in grid]
    odd = average(surprise, own)
    usual = np.array([_usual(odd[truth == i], sizes[truth == i]) for i in range(len(languages))])
    model = Model(languages, table, surprise, float(grid[int(np.argmin(loss))]), usual, 0.0)

    members = [model.strangeness(odd[i], sizes[i]) for i in places[logits.argmax(axis=1) == truth]]
    mixed = average(surprise, [(r[3], r[4]) for r in held])
    strangers = [model.strangeness(mixed[i], sizes[i]) for i in places]
    if len(languages) > 1:
        others = [np.delete(by_language, i, axis=1).min(axis=1) for i in range(len(languages))]
        strangers += [model.strangeness((c / c.sum()) @ others[t][b], c.sum(), t) for t, (b, c) in zip(truth, own, strict=True)]
    high = float(np.quantile(members, COVERAGE)) if len(members) else 0.0
    model.limit = max(high, (high + float(np.quantile(strangers, STRANGERS))) / 2)
    return model


def sample(docs: DataFrame, usable, text_col: str, lang_col: str) -> list[Row]:
    """Buckets and counts, of the text and with its letters shuffled, of about PER_LANGUAGE whole texts of each language, chosen by a hash of the text."""
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    draw = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, PER_LANGUAGE / n))]) if sizes else None
    if share is None:
        return []
    chosen = rows.where(draw < share[F.col("lang")])

    def compute(texts: list[bytes]) -> list[pa.Array]:
        found = [(*bucket_counts(t), *bucket_counts(shuffled(t))) for t in map(bytes.decode, texts)]
        return [pa.array([f[i].astype("<i4").tobytes() for f in found], pa.binary()) for i in range(4)]

    parts = ["buckets", "counts", "mixed_buckets", "mixed_counts"]
    got = append_columns(chosen, "text", compute, [(c, T.BinaryType()) for c in parts])
    kept = got.select("lang", *parts).orderBy(F.xxhash64("buckets", "counts"), "lang").limit(2 * PER_LANGUAGE * len(sizes))
    return [(r.lang, *(np.frombuffer(r[c], "<i4") for c in parts)) for r in kept.toLocalIterator()]


def fit(docs: DataFrame, usable=None, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the labelled rows of ``docs`` for which ``usable`` holds."""
    return train(sample(docs, F.lit(True) if usable is None else usable, text_col, lang_col))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` and lang_pred, score (calibrated probability), accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers, whatever the input

    def compute(texts: list[bytes]) -> list[pa.Array]:
        found = [shared.value.predict(t.decode()) for t in texts]
        return [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]

    return append_columns(docs, text_col, compute, [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("accepted", T.BooleanType())])
