"""Nearest-neighbour search over vector tables.

Distances are squared Euclidean, rounded to six decimals; ties go to the
smaller id. Three ways lead to the same exact answer:

* few queries: their matrix is broadcast after its size has been checked, and
  the collection is streamed once without a shuffle;
* many queries, or queries restricted to a key: both sides are cut into blocks,
  a block pair is a few small matrix products, and only the k best rows of each
  pair leave the task. A key with very many rows is cut into several blocks.
  Blocks without a key are as large as memory allows, so that rows are copied to
  few of them, but enough for all cores;
* clustered (``cells``): k-means cells, where cells that cannot hold a closer row
  are left out by the triangle inequality.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.functions.blocks import CHUNK_CELLS, TILE, by_key, codes_of, k_best, matrix, with_vector
from hearth.operators.ordering import top_per_group
from hearth.session import parallelism

BROADCAST_BYTES = 32 << 20
# vectors of one side of a block; the more fit, the less often rows are copied to other blocks
BLOCK_BYTES = 64 << 20
# rows of one key in one block: a busy key should give work to several tasks
KEY_BLOCK_ROWS = 32_000
# pairs of rows that are worth a task of their own (a second), and most of them in one task
LEAST_PAIRS, MOST_PAIRS = 1 << 28, 1 << 34
# most hot keys that are joined by broadcast
HOT_KEYS_BROADCAST = 100_000
BLOCK_KEYS = ["_bucket", "_lb", "_rb"]


# ---- blocks --------------------------------------------------------------------


def _dimension(df: DataFrame, vector: str) -> int:
    row = df.select(F.size(vector).alias("dim")).filter("dim > 0").first()
    return row["dim"] if row else 1


def _block_rows(df: DataFrame, vector: str, given: int | None, by: str | None) -> int:
    fitting = max(1_000, BLOCK_BYTES // (8 * _dimension(df, vector)))
    return given or (min(fitting, KEY_BLOCK_ROWS) if by else fitting)


def _tasks(spark: SparkSession, pairs: int) -> int:
    """Tasks that so many pairs of rows are dealt to: some per core, more where one would have too many."""
    return max(1, min(ceil(pairs / LEAST_PAIRS), 4 * parallelism(spark)), ceil(pairs / MOST_PAIRS))


def _cuts(sizes: tuple[int, int], block_rows: int, tasks: int) -> tuple[int, int]:
    """Blocks of either side: none of more than ``block_rows`` rows, and at least ``tasks`` pairs of blocks."""
    cuts = [max(1, ceil(n / block_rows)) for n in sizes]
    while cuts[0] * cuts[1] < tasks:
        larger = 0 if sizes[0] / cuts[0] >= sizes[1] / cuts[1] else 1
        if cuts[larger] >= sizes[larger]:
            break
        cuts[larger] += 1
    return cuts[0], cuts[1]


def _blocked(left: DataFrame, right: DataFrame, left_id: list[str], right_id: list[str], by: str | None, block_rows: int):
    """Add ``_bucket, _lb, _rb`` to both sides, so that every pair that has to be
    compared meets in exactly one group, and no group holds much more than
    ``block_rows`` rows of a side."""
    def hashed(names: list[str], n) -> F.Column:
        return F.pmod(F.xxhash64(*names), n).cast("int")

    if by is None:
        sizes = left.count(), right.count()
        nl, nr = _cuts(sizes, block_rows, _tasks(left.sparkSession, sizes[0] * sizes[1]))
        left = left.withColumn("_bucket", F.lit(0)).withColumn("_lb", hashed(left_id, F.lit(nl)))
        right = right.withColumn("_bucket", F.lit(0)).withColumn("_rb", hashed(right_id, F.lit(nr)))
        left = left.withColumn("_rb", F.explode(F.sequence(F.lit(0), F.lit(nr - 1))))
        right = right.withColumn("_lb", F.explode(F.sequence(F.lit(0), F.lit(nl - 1))))
        # adaptive execution merges partitions by their bytes, but work goes with the pairs of rows
        return (side.repartition(2 * nl * nr, *BLOCK_KEYS) for side in (left, right)) if nl * nr > 1 else (left, right)

    per_key = (
        left.groupBy(by).agg(F.count("*").alias("n_left"), F.lit(0).cast("long").alias("n_right"))
        .unionByName(right.groupBy(by).agg(F.lit(0).cast("long").alias("n_left"), F.count("*").alias("n_right")))
        .groupBy(by)
        .agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))
    )
    is_hot = (F.col("n_left") > block_rows) | (F.col("n_right") > block_rows)
    totals = per_key.agg(
        F.coalesce(F.sum(F.col("n_left") + F.col("n_right")), F.lit(0)).alias("rows"),
        F.count_if(is_hot).alias("hot"),
    ).first()
    buckets = max(ceil(totals["rows"] / block_rows), parallelism(left.sparkSession))
    left = left.withColumn("_bucket", hashed([by], F.lit(buckets)))
    right = right.withColumn("_bucket", hashed([by], F.lit(buckets)))
    if totals["hot"] == 0:
        for name in ("_lb", "_rb"):
            left, right = left.withColumn(name, F.lit(0)), right.withColumn(name, F.lit(0))
        return left, right

    hot = per_key.filter(is_hot).select(
        by,
        F.ceil(F.col("n_left") / block_rows).cast("int").alias("_nl"),
        F.ceil(F.col("n_right") / block_rows).cast("int").alias("_nr"),
    )
    if totals["hot"] <= HOT_KEYS_BROADCAST:
        hot = F.broadcast(hot)

    def split(side: DataFrame, own: str, other: str, ids: list[str], n_own: str, n_other: str) -> DataFrame:
        columns = side.columns
        side = side.join(hot, by, "left")
        n_own, n_other = (F.greatest(F.coalesce(F.col(n), F.lit(1)), F.lit(1)) for n in (n_own, n_other))
        side = side.withColumn(own, hashed(ids, n_own))
        return side.withColumn(other, F.explode(F.sequence(F.lit(0), n_other - 1))).select(*columns, own, other)

    return (
        split(left, "_lb", "_rb", left_id, "_nl", "_nr"),
        split(right, "_rb", "_lb", right_id, "_nr", "_nl"),
    )


def _grouped(left: DataFrame, right: DataFrame):
    # both sides may come from one table: give the right one column identities of its own
    right = right.toDF(*right.columns)
    return left.groupBy(*BLOCK_KEYS).cogroup(right.groupBy(*BLOCK_KEYS))


# ---- exact search ----------------------------------------------------------------


def _field(df: DataFrame, name: str, new: str) -> T.StructField:
    return T.StructField(new, df.schema[name].dataType)


def _hit_schema(queries: DataFrame, points: DataFrame, query_id: str, point_id: str) -> T.StructType:
    return T.StructType(
        [_field(queries, query_id, "query_id"), _field(points, point_id, "id"), T.StructField("distance", T.DoubleType())]
    )


def best_hits(hits: DataFrame, k: int) -> DataFrame:
    return top_per_group(hits, ["query_id"], [F.col("distance"), F.col("id")], k)


def _broadcast_search(queries: DataFrame, points: DataFrame, query_id: str, point_id: str, vector: str, k: int, skip_self: bool) -> DataFrame:
    schema = _hit_schema(queries, points, query_id, point_id)
    # the caller has checked the size of the query side
    table = with_vector(queries.select(query_id, vector).toArrow(), 1)
    shared = queries.sparkSession.sparkContext.broadcast((table.column(0).to_pandas(), matrix(table.column(1))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = shared.value
        best = pd.DataFrame({"q": [], "id": [], "d": []})
        # distance of the k-th hit so far: what lies beyond it is not kept
        bound = np.full(len(asked), np.inf)
        pending: list[pd.DataFrame] = []

        def merged() -> pd.DataFrame:
            parts = [p for p in (best, *pending) if len(p)]
            pending.clear()
            if not parts:
                return best
            rows = pd.concat(parts, ignore_index=True).sort_values(["q", "d", "id"], kind="stable")
            rows = rows.groupby("q", sort=False).head(k)
            full = rows.groupby("q")["d"].agg(["size", "max"]).query("size == @k")
            bound[full.index.to_numpy()] = full["max"].to_numpy()
            return rows

        for batch in batches:
            batch = with_vector(batch, 1)
            if batch.num_rows == 0 or len(asked) == 0:
                continue
            order = np.argsort(batch.column(0).to_pandas().to_numpy(), kind="stable")
            names = batch.column(0).to_pandas().iloc[order].reset_index(drop=True)
            r, c, d = k_best(asked, matrix(batch.column(1))[order], k, codes_of(ids, names) if skip_self else None, within=bound)
            pending.append(pd.DataFrame({"q": r, "id": names.to_numpy()[c], "d": d}))
            if sum(map(len, pending)) >= k * len(asked):
                best = merged()
        best = merged()
        if len(best):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids.to_numpy()[best["q"].to_numpy()]),
                    pa.array(best["id"].to_numpy()),
                    pa.array(best["d"].to_numpy()),
                ],
                names=["query_id", "id", "distance"],
            )

    scanned = points.select(point_id, vector)
    tasks = _tasks(points.sparkSession, len(table) * points.count())
    if tasks > 1 and scanned.rdd.getNumPartitions() < tasks:
        # a table of few splits would leave most cores idle
        scanned = scanned.repartition(tasks)
    return best_hits(scanned.mapInArrow(scan, schema), k)


def _moment(column: str, missing: int) -> F.Column:
    return F.coalesce(F.unix_micros(column), F.lit(missing).cast("long")).alias("_time")


def blocked_search(queries, points, query_id, point_id, vector, k, skip_self, by, block_rows, earlier=None) -> DataFrame:
    """``queries`` may hold one row per (query, key); hits carry the query id only.

    Without a key ``block_rows`` bounds a matrix product, not what a task holds.
    """
    schema = _hit_schema(queries, points, query_id, point_id)
    extra = [by] if by else []
    limits = np.iinfo(np.int64)
    left = queries.select(query_id, vector, *extra, *([_moment(earlier[0], limits.min)] if earlier else []))
    right = points.select(point_id, vector, *extra, *([_moment(earlier[1], limits.max)] if earlier else []))
    left, right = _blocked(left, right, [query_id], [point_id], by, _block_rows(queries, vector, block_rows if by else None, by))
    tile = TILE if by or not block_rows else (min(TILE[0], block_rows), min(TILE[1], block_rows))

    def search(ls: pa.Table, rs: pa.Table) -> pa.Table:
        ls, rs = with_vector(ls, 1), with_vector(rs, 1)
        out = []
        if ls.num_rows and rs.num_rows:
            qid, pid = ls.column(0).to_pandas(), rs.column(0).to_pandas()
            order = np.argsort(pid.to_numpy(), kind="stable")
            pid = pid.iloc[order].reset_index(drop=True)
            qs, ps = matrix(ls.column(1)), matrix(rs.column(1))[order]
            if extra:
                groups = by_key(ls.column(2).to_pandas(), rs.column(2).to_pandas().iloc[order].reset_index(drop=True))
            else:
                groups = iter([(np.arange(len(qid)), np.arange(len(pid)))])
            codes = codes_of(qid, pid) if skip_self else None
            asked, known = (ls.column("_time").to_numpy(), rs.column("_time").to_numpy()[order]) if earlier else (None, None)
            for li, ri in groups:
                if len(ri):
                    same = (codes[0][li], codes[1][ri]) if codes else None
                    r, c, d = k_best(qs[li], ps[ri], k, same, (asked[li], known[ri]) if earlier else None, tile)
                    out.append((qid.to_numpy()[li[r]], pid.to_numpy()[ri[c]], d))
        q, p, d = (np.concatenate(x) for x in zip(*out)) if out else ([], [], [])
        names = ["query_id", "id", "distance"]
        arrow = [ls.schema.field(0).type, rs.schema.field(0).type, pa.float64()]
        return pa.table([pa.array(x, type=t) for x, t in zip((q, p, d), arrow)], names=names)

    return best_hits(_grouped(left, right).applyInArrow(search, schema), k)


def nearest(
    queries: DataFrame,
    points: DataFrame,
    k: int = 3,
    query_id: str = "query_id",
    point_id: str = "id",
    vector: str = "embedding",
    by: str | None = None,
    skip_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int | None = None,
    earlier: tuple[str, str] | None = None,
) -> DataFrame:
    """``(query_id, id, distance, rank)`` of the exact k nearest points per query.

    With ``by`` a query only sees points of its own key; with ``earlier``, the
    time columns of queries and points, only points of an earlier time, and none
    where a time is null. Ids must be unique on each side. Rows without a vector
    are ignored.
    """
    if by is None and earlier is None:
        # counting rows needs no vector, so that computed vectors are not computed for it
        if queries.count() * _dimension(queries, vector) * 8 <= broadcast_bytes:
            return _broadcast_search(queries, points, query_id, point_id, vector, k, skip_self)
    return blocked_search(queries, points, query_id, point_id, vector, k, skip_self, by, block_rows, earlier)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row ``(truth_rows, found_rows, recall)``."""
    marked = truth.select("query_id", "id").join(
        found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left"
    )
    return marked.agg(
        F.count("*").alias("truth_rows"),
        F.count("hit").alias("found_rows"),
        (F.count("hit") / F.count("*")).alias("recall"),
    )


def with_content(hits: DataFrame, points: DataFrame, point_id: str = "id", columns: list[str] = ["document"]) -> DataFrame:
    """Attach columns of the collection to hits: documents are only read for rows that were hit."""
    return hits.join(points.select(F.col(point_id).alias("id"), *columns), "id")


# ---- greedy matching -----------------------------------------------------------------


def greedy_match(tokens: DataFrame, row_id: str = "row_id", side: str = "side", pos: str = "pos", vector: str = "vec", block_rows: int | None = None) -> DataFrame:
    """Per row precision, recall and F1 of greedy token-vector matching.

    ``side`` is ``cand`` or ``ref``. Each block pair yields one best value per
    token, so no token pair is ever written out. A row with one empty side scores 0.
    """
    cut = tokens.select(row_id, pos, vector, side)
    left = cut.filter(F.col(side) == "cand").drop(side)
    right = cut.filter(F.col(side) == "ref").drop(side)
    schema = T.StructType(
        [
            _field(tokens, row_id, row_id),
            T.StructField("cand", T.BooleanType()),
            _field(tokens, pos, pos),
            T.StructField("best", T.DoubleType()),
        ]
    )
    left, right = _blocked(left, right, [row_id, pos], [row_id, pos], row_id, _block_rows(tokens, vector, block_rows, row_id))

    def match(ls: pa.Table, rs: pa.Table) -> pa.Table:
        ls, rs = with_vector(ls, 2), with_vector(rs, 2)
        lk, rk = ls.column(0).to_pandas(), rs.column(0).to_pandas()
        lv, rv = matrix(ls.column(2)), matrix(rs.column(2))
        lbest, rbest = np.full(len(lk), np.nan), np.full(len(rk), np.nan)
        for li, ri in by_key(lk, rk):
            step = max(1, CHUNK_CELLS // max(1, len(ri)))
            for start in range(0, len(li), step) if len(ri) else ():
                part = li[start : start + step]
                sims = lv[part] @ rv[ri].T
                lbest[part] = sims.max(1)
                rbest[ri] = np.fmax(rbest[ri], sims.max(0))
        tables = []
        for source, best, cand in ((ls, lbest, True), (rs, rbest, False)):
            columns = [source.column(0), pa.array([cand] * len(best), pa.bool_()), source.column(1), pa.array(best, from_pandas=True)]
            tables.append(pa.table(columns, names=[row_id, "cand", pos, "best"]))
        return pa.concat_tables(tables)

    best = _grouped(left, right).applyInArrow(match, schema)
    per_token = best.groupBy(row_id, "cand", pos).agg(F.max("best").alias("best"))
    per_row = per_token.groupBy(row_id).agg(
        F.coalesce(F.avg(F.when(F.col("cand"), F.coalesce("best", F.lit(0.0)))), F.lit(0.0)).alias("precision"),
        F.coalesce(F.avg(F.when(~F.col("cand"), F.coalesce("best", F.lit(0.0)))), F.lit(0.0)).alias("recall"),
    )
    total = F.col("precision") + F.col("recall")
    f1 = F.when(total != 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(F.lit(0.0))
    return per_row.withColumn("f1", f1)
