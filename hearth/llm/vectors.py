"""A stated set of query vectors against all vectors of a table, block by block.

Queries and rows are dealt into blocks of bounded size; each pair of blocks is
one group of a cogroup, and only the k best rows of each query leave it. The
best of all blocks are ranked per query. Vectors of different lengths never meet.

An id stands for one vector: of several rows with the same id and length of
vector the least vector counts, on both sides, so that no id is found twice by a
query. Repeats are reduced before rows are dealt into blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_ROWS = 4096
BLOCK_ROWS = 4096
TASKS_PER_CORE = 4


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id long, vector array<double>): rows with an id and a non-empty vector of finite components only."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where("id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0").where(~bad)


def one_per_id(rows: DataFrame) -> DataFrame:
    """One row of every id and length of vector, the least vector."""
    found = rows.groupBy("id", F.size("vector").alias("width")).agg(F.min("vector").alias("vector"))
    return found.select("id", "vector")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long arrays as rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def best_per_query(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of every query, ties to smaller ids."""
    order = np.lexsort((ids, -scores, query))
    ranked = query[order]
    starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
    within = np.arange(len(ranked)) - np.repeat(starts, np.diff(np.append(starts, len(ranked))))
    return order[within < k]


Search = Callable[[pa.Table, pa.Table], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def search_blocks(rows: DataFrame, is_query, search: Search, k: int, score_type: str) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows for which ``is_query`` holds, against all other rows.

    ``rows`` has id, vector and what ``search`` needs of both sides. ``search``
    yields (query ids, row ids, scores) of good candidates for a pair of blocks,
    all k best of the block among them, besides the query itself. Ids are
    unique among rows of one width (``one_per_id``).
    """
    total, asked = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    row_blocks = max(1, -(-total // BLOCK_ROWS), TASKS_PER_CORE * cores)
    query_blocks = max(1, -(-asked // QUERY_ROWS))

    def block(n: int):
        return F.pmod(F.xxhash64("id"), F.lit(n))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    keyed = rows.withColumn("width", F.size("vector"))
    left = keyed.where(is_query).withColumn("qb", block(query_blocks)).withColumn("rb", every(row_blocks))
    right = keyed.withColumn("rb", block(row_blocks)).withColumn("qb", every(query_blocks))
    kind = pa.float64() if score_type == "double" else pa.int64()

    def pair(queries: pa.Table, own: pa.Table) -> pa.Table:
        found = list(search(queries, own)) if queries.num_rows and own.num_rows else []
        query, ids, scores = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        other = query != ids
        query, ids, scores = query[other], ids[other], scores[other]
        kept = best_per_query(query, ids, scores, k)
        return pa.table({"query_id": pa.array(query[kept], pa.int64()), "vec_id": pa.array(ids[kept], pa.int64()), "score": pa.array(scores[kept], kind)})

    keys = ["width", "qb", "rb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pair, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
