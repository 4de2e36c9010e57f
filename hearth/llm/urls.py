"""URL filters by the ratio of two character language models.

Rules of a host and a path decide the URLs they fit; those URLs, accepted and
rejected, train one smoothed variable-order Markov model each, and all other
URLs are judged by the difference of their log-likelihoods, divided by their
length. A model blends, byte by byte, the counts after contexts of 0 to ``ORDER``
bytes (Witten-Bell: the more different bytes followed a context, the more weight
has the next shorter one). A context of one byte or more enters only if it was
seen ``MIN_SEEN`` times, so the order varies with the data. The threshold is
calibrated on URLs the counts never saw.

The models count all distinct URLs that a rule decides, whole, but a fifth, chosen
by hash, that is held out and calibrates the threshold. Counting, scoring and
the threshold are Spark jobs; only counts of contexts seen ``MIN_SEEN`` times
reach the driver and the tasks.

A null URL, or one without ``://``, has an empty host and path; its score is that
of its bytes, a null's that of none. Where one kind has no URL to learn from
there is no model: the score is null and URLs that no rule fits are allowed.
Equal URLs have equal results; repeated rows stay. Columns of the same names are
replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.llm.common import append_columns, bound_batches
from hearth.session import materialised, shuffle_width

ORDER = 5
MIN_SEEN = 3
HELD_OUT = 5

# symbols: 0 stands before the first byte, 1 is the end, a byte is its value and 2
START, END, SHIFT, SYMBOLS = 0, 1, 2, 257
BITS = 9
TAG = BITS * (ORDER + 1)

Rule = tuple[str, str, str]  # allow or block, host, path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def with_rule(df: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """``df`` and host, path, rule (host and path of the longest rule that fits, else null) and ruled (its verdict)."""
    url = F.col(f"`{url_col}`")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("host", "path", "rule", "ruled")]
    parts = df.select(*kept, host_of(url).alias("host"), path_of(url).alias("path"))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, ruled = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    return parts.select("*", rule.alias("rule"), ruled.alias("ruled"))


def codes(urls: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """For orders 0 to ORDER the context and symbol at every place of the URLs as one number; and symbols per URL."""
    padded = [np.concatenate((np.zeros(ORDER, np.int64), np.frombuffer(u, np.uint8).astype(np.int64) + SHIFT, [END])) for u in urls]
    line = np.concatenate([np.zeros(0, np.int64), *padded])
    sizes = np.array([len(u) + 1 for u in urls], np.int64)
    starts = np.cumsum(sizes + ORDER) - sizes
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    found, number = [], np.zeros(len(at), np.int64)
    for order in range(ORDER + 1):
        number = number | (line[at - order] << (BITS * order))
        found.append(number | (order << TAG))
    return found, sizes


def count_codes(urls: DataFrame) -> DataFrame:
    """(code, allow, block): how often each context and symbol occurs in the URLs (url binary, kind) of either kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = codes(batch.column(0).to_pylist())
            allowed = np.repeat(np.array(batch.column(1).to_pylist()) == "allow", sizes)
            every = np.concatenate(found)
            distinct, place = np.unique(every, return_inverse=True)
            allow = np.bincount(place, weights=np.tile(allowed, ORDER + 1), minlength=len(distinct))
            columns = [distinct, allow.astype(np.int64), (np.bincount(place, minlength=len(distinct)) - allow).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["code", "allow", "block"])

    bound_batches(urls.sparkSession)
    return urls.mapInArrow(run, "code long, allow long, block long").groupBy("code").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))


def context_of(code: np.ndarray) -> np.ndarray:
    """The code without its last symbol; the order stays part of it."""
    order = code >> TAG
    return (order << TAG) | ((code & ((1 << TAG) - 1)) >> BITS)


class MarkovModel:
    """Smoothed counts of one kind: log-probabilities of codes."""

    def __init__(self, code: np.ndarray, count: np.ndarray):
        code, count = code[count > 0], count[count > 0]
        context, place = np.unique(context_of(code), return_inverse=True)
        total, kinds = np.bincount(place, weights=count), np.bincount(place)
        used = (total >= MIN_SEEN) | (context >> TAG == 0)
        self.code, self.count = code[used[place]], count[used[place]].astype(float)
        self.context, self.total, self.kinds = context[used], total[used], kinds[used].astype(float)

    @staticmethod
    def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0.0)

    def log_probability(self, by_order: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(by_order[0]), 1 / SYMBOLS)
        for code in by_order:
            context = context_of(code)
            total, kinds = self._look_up(self.context, self.total, context), self._look_up(self.context, self.kinds, context)
            seen = total > 0
            blended = (self._look_up(self.code, self.count, code) + kinds * p) / np.where(seen, total + kinds, 1)
            p = np.where(seen, blended, p)
        return np.log(p)


class RatioModel:
    """Both models and the threshold."""

    def __init__(self, code: np.ndarray, allow: np.ndarray, block: np.ndarray):
        order = np.argsort(code)
        self.allow, self.block = MarkovModel(code[order], allow[order]), MarkovModel(code[order], block[order])
        self.threshold = 0.0

    def scores(self, urls: list[bytes]) -> np.ndarray:
        """Log-likelihood of being accepted less that of being rejected, per symbol."""
        if not urls:
            return np.zeros(0)
        by_order, sizes = codes(urls)
        # equal contexts are common among URLs: each is worked out once
        _, first, place = np.unique(by_order[-1], return_index=True, return_inverse=True)
        few = [c[first] for c in by_order]
        gain = (self.allow.log_probability(few) - self.block.log_probability(few))[place]
        return np.add.reduceat(gain, np.cumsum(sizes) - sizes) / sizes


def calibrated(allowed: np.ndarray, blocked: np.ndarray) -> float:
    """The threshold with the best mean of both kinds' right shares; in the widest gap among equals."""
    if not len(allowed) or not len(blocked):
        return 0.0
    edges = np.unique(np.concatenate((allowed, blocked)))
    cuts = np.concatenate(([edges[0] - 1], (edges[1:] + edges[:-1]) / 2, [edges[-1] + 1]))
    gaps = np.concatenate(([0], np.diff(edges), [0]))
    right = (allowed[:, None] >= cuts).mean(axis=0) + (blocked[:, None] < cuts).mean(axis=0) if len(cuts) < 2000 else np.array([
        1 - np.searchsorted(np.sort(allowed), c) / len(allowed) + np.searchsorted(np.sort(blocked), c) / len(blocked) for c in cuts])
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(cuts[best[np.argmax(gaps[best])]])


def _model_counts(labelled: DataFrame) -> DataFrame:
    """``count_codes`` without what the models leave out: of either kind, contexts seen less than MIN_SEEN times."""
    counted = count_codes(labelled)
    tag = F.shiftright("code", TAG)
    low = F.shiftright(F.col("code").bitwiseAND(F.lit((1 << TAG) - 1)), BITS)
    context = F.shiftleft(tag, TAG).bitwiseOR(low)
    by = counted.withColumn("context", context)
    totals = by.groupBy("context").agg(F.sum("allow").alias("all_allow"), F.sum("block").alias("all_block"))
    seen = [F.when((F.col(f"all_{kind}") >= MIN_SEEN) | (tag == 0), F.col(kind)).otherwise(F.lit(0)).alias(kind) for kind in ("allow", "block")]
    return by.join(totals, "context").select("code", *seen).where("allow > 0 or block > 0")


def _threshold(scored: DataFrame) -> float:
    """``calibrated`` over all rows (score, kind): running counts range by range, of which only the sizes reach the driver."""
    allow = F.count_if(F.col("kind") == "allow").alias("allow")
    edges = scored.groupBy("score").agg(allow, F.count_if(F.col("kind") == "block").alias("block"))
    edges = materialised(edges.repartitionByRange(shuffle_width(scored.sparkSession), "score").withColumn("range", F.spark_partition_id()), "scores")
    sizes = edges.groupBy("range").agg(F.min("score"), F.max("score"), F.sum("allow"), F.sum("block")).orderBy("range").collect()
    totals = sum(r[3] for r in sizes), sum(r[4] for r in sizes)
    if not totals[0] or not totals[1]:
        return 0.0
    # of every range: the highest score before it, and how many of either kind have it or less
    before, last, below = {}, None, (0, 0)
    for number, _, most, allowed, blocked in sizes:
        before[number] = (last, *below)
        last, below = most, (below[0] + allowed, below[1] + blocked)

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("score").to_numpy())
        score, allowed, blocked = (table.column(n).to_numpy()[order] for n in ("score", "allow", "block"))
        least, n_allow, n_block = before[table.column("range")[0].as_py()]
        lower = np.concatenate(([score[0] if least is None else least], score[:-1]))
        # a cut below each score: accepted ones from there on are right, rejected ones below it
        under = n_allow + np.cumsum(allowed) - allowed, n_block + np.cumsum(blocked) - blocked
        right = 1 - under[0] / totals[0] + under[1] / totals[1]
        gap, cut = score - lower, (score + lower) / 2
        if least is None:
            cut[0] = score[0] - 1
        best = np.flatnonzero(right >= right.max() - 1e-12)
        at = best[np.argmax(gap[best])]
        return pa.table({"right": [float(right[at])], "gap": [float(gap[at])], "cut": [float(cut[at])]})

    found = [tuple(r) for r in edges.groupBy("range").applyInArrow(run, "right double, gap double, cut double").collect()]
    # and the cut above all scores
    found.append((1.0, 0.0, last + 1))
    most = max(r[0] for r in found)
    near = sorted((r for r in found if r[0] >= most - 1e-12), key=lambda r: (-r[1], r[2]))
    return float(near[0][2])


def fit(ruled: DataFrame, url_col: str = "url") -> RatioModel | None:
    """A model learnt from all rows of ``with_rule`` that a rule decides; None where a kind is missing."""
    labelled = ruled.select(F.col(f"`{url_col}`").cast("binary").alias("url"), F.col("ruled").alias("kind")).where("kind is not null and url is not null")
    # distinct first, so that an address repeated over and over counts once
    distinct = labelled.groupBy("url", "kind").agg(F.lit(0).alias("_")).select("url", "kind", F.xxhash64("url").alias("hash"))
    # as a decimal, since a double loses the last digits of a hash
    held = F.pmod(F.floor(F.col("hash").cast("decimal(20,0)") / 7), F.lit(HELD_OUT)) == 0
    rows = materialised(distinct.withColumn("held", held), "urls")
    if {r[0] for r in rows.where("not held").select("kind").distinct().collect()} != {"allow", "block"}:
        return None
    learnt = _model_counts(rows.where("not held").select("url", "kind")).toArrow()
    model = RatioModel(*[learnt.column(c).to_numpy() for c in ("code", "allow", "block")])
    shared = rows.sparkSession.sparkContext.broadcast(model)
    scored = append_columns(rows.where("held").select("url", "kind"), "url", lambda urls: [pa.array(shared.value.scores(urls), pa.float64())], [("score", T.DoubleType())])
    model.threshold = _threshold(scored.select("score", "kind"))
    return model


def judge(df: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """``df`` and host, path, rule, score and verdict: allow or block, by the longest rule that fits or by the models."""
    ruled = with_rule(df, rules, url_col)
    model = fit(ruled, url_col)
    by_rule = F.col("ruled")
    if model is None:
        found = ruled.withColumn("score", F.lit(None).cast("double"))
        return found.withColumn("verdict", F.coalesce(by_rule, F.lit("allow"))).drop("ruled")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def compute(urls: list[bytes]) -> list[pa.Array]:
        return [pa.array(shared.value.scores(urls), pa.float64())]

    found = append_columns(ruled, url_col, compute, [("score", T.DoubleType())])
    by_model = F.when(F.col("score") >= model.threshold, "allow").otherwise("block")
    return found.withColumn("verdict", F.coalesce(by_rule, by_model)).drop("ruled")
