"""Nearest neighbours through k-means cells, in passing or over a stored index.

Every row belongs to the cell of its nearest centre; a cell's radius is the
largest distance of its rows from the centre. A query expands cells best first,
by the least distance a row of the cell can have. With ``exact`` it goes on, more
cells at a time, while some cell can still hold a closer row than its k-th hit;
bounds are applied inside the task that assigns cells, so only (query, cell)
pairs that survive leave it.

A stored index keeps its rows in one folder per cell. A search scans the folders
of the cells its queries expand and no others (dynamic partition pruning). New
rows go to the cells of the centres they are nearest to; the centres stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.functions.blocks import CHUNK_CELLS, DISTANCE_DECIMALS, distances, matrix, with_vector
from hearth.operators.nearest import best_hits, blocked_search
from hearth.session import materialised

# centres, radii and sizes travel to every task
MOST_CENTRE_BYTES = 256 << 20
# rounding of distances must not exclude a cell
SLACK = 10.0 ** (-DISTANCE_DECIMALS / 2 + 1)


@dataclass
class Cells:
    """Centres and, once rows are assigned, the radius and number of rows of every cell."""

    centres: np.ndarray
    radius: np.ndarray | None = None
    rows: np.ndarray | None = None

    def __post_init__(self):
        if self.centres.nbytes > MOST_CENTRE_BYTES:
            raise ValueError(f"{self.centres.nbytes} bytes of centres; every task holds them")


def fit_cells(points: DataFrame, n_cells: int, vector: str = "embedding", seed: int = 42) -> Cells:
    """Centres from distributed k-means over all points."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    features = points.filter(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=n_cells, seed=seed, maxIter=10).fit(features)
    return Cells(np.array(model.clusterCenters(), dtype=np.float64))


def _gaps(vectors: np.ndarray, centres: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Distances from every centre, a bounded number of rows at a time."""
    step = max(1, CHUNK_CELLS // max(1, len(centres)))
    for low in range(0, len(vectors), step):
        yield low, np.sqrt(distances(vectors[low : low + step], centres))


def assign_rows(points: DataFrame, cells: Cells, vector: str = "embedding") -> DataFrame:
    """``points`` with the ``cell`` of the nearest centre and ``cell_gap``, the distance to it; rows without a vector go."""
    shared, place = points.sparkSession.sparkContext.broadcast(cells.centres), points.columns.index(vector)
    schema = T.StructType([*points.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("cell_gap", T.DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = with_vector(batch, place)
            if not batch.num_rows:
                continue
            own = [(g.argmin(axis=1), g.min(axis=1)) for _, g in _gaps(matrix(batch.column(place)), shared.value)]
            cell, gap = (np.concatenate(x) for x in zip(*own, strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(gap)], [f.name for f in schema.fields])

    return points.mapInArrow(assign, schema)


def sizes_of(celled: DataFrame) -> DataFrame:
    return celled.groupBy("cell").agg(F.max("cell_gap").alias("radius"), F.count("*").alias("rows"))


def with_sizes(cells: Cells, sizes: DataFrame) -> Cells:
    """``cells`` with radii and numbers of rows from one row per cell."""
    radius, rows = np.full(len(cells.centres), -1.0), np.zeros(len(cells.centres), np.int64)
    for cell, r, n in sizes.select("cell", "radius", "rows").collect():
        radius[cell], rows[cell] = r, n
    return Cells(cells.centres, radius, rows)


def expand(queries: DataFrame, cells: Cells, first: int, last: int) -> DataFrame:
    """(query_id, v, cell): the cells ranked ``first`` to ``last`` for each query ``(query_id, v, reach)``, less those
    that cannot hold a row within ``reach``, the distance of its k-th hit (null: none yet)."""
    shared = queries.sparkSession.sparkContext.broadcast(cells)
    schema = T.StructType([queries.schema["query_id"], queries.schema["v"], T.StructField("cell", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        filled = np.flatnonzero(known.rows > 0)
        for batch in batches:
            batch = with_vector(batch, 1)
            if not batch.num_rows or not len(filled):
                continue
            reach = np.nan_to_num(batch.column(2).to_numpy(zero_copy_only=False).astype(float), nan=np.inf)
            rows, picked = [], []
            for low, gap in _gaps(matrix(batch.column(1)), known.centres[filled]):
                least = np.maximum(gap - known.radius[filled], 0.0)
                order = np.lexsort((gap, least), axis=1)[:, first:last]
                near = np.take_along_axis(least, order, 1) <= reach[low : low + len(gap), None] + SLACK
                r, c = np.nonzero(near)
                rows.append(r + low)
                picked.append(filled[order[r, c]])
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(picked), pa.int32())], ["query_id", "v", "cell"])

    return queries.select("query_id", "v", "reach").mapInArrow(run, schema)


def search_cells(queries: DataFrame, rows_of, cells: Cells, k: int, n_probe: int, exact: bool, skip_self: bool = False, block_rows: int | None = None) -> DataFrame:
    """Hits of queries ``(query_id, v)``; ``rows_of`` gives the rows ``(id, v, cell)`` of the cells in a table."""

    def hits_in(pairs: DataFrame) -> DataFrame:
        return blocked_search(pairs, rows_of(pairs), "query_id", "id", "v", k, skip_self, "cell", block_rows).drop("rank")

    asked = queries.withColumn("reach", F.lit(None).cast("double"))
    found = hits_in(materialised(expand(asked, cells, 0, n_probe), "pairs"))
    if not exact:
        return best_hits(found, k)
    first, last, total = n_probe, 3 * n_probe, int((cells.rows > 0).sum())
    while first < total:
        found = materialised(best_hits(found, k).drop("rank"), "hits")
        reach = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.sqrt(F.max("distance"))).alias("reach"))
        # a query without hits yet keeps a null reach and goes on
        pairs = materialised(expand(queries.join(reach, "query_id", "left"), cells, first, last), "pairs")
        if pairs.isEmpty():
            break
        found = found.unionByName(hits_in(pairs))
        first, last = last, 3 * last
    return best_hits(found, k)


def nearest_clustered(
    queries: DataFrame,
    points: DataFrame,
    k: int = 3,
    n_cells: int = 16,
    n_probe: int = 4,
    exact: bool = False,
    query_id: str = "query_id",
    point_id: str = "id",
    vector: str = "embedding",
    skip_self: bool = False,
    block_rows: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Search in the ``n_probe`` best cells of each query; with ``exact`` in every cell that can hold a closer row,
    which makes the answer equal to :func:`hearth.operators.nearest.nearest`."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("v"))
    rows = points.select(F.col(point_id).alias("id"), F.col(vector).alias("v"))
    cells = fit_cells(rows, n_cells, "v", seed)
    celled = materialised(assign_rows(rows, cells, "v"), "cells")
    cells = with_sizes(cells, sizes_of(celled))
    return search_cells(asked, lambda pairs: celled, cells, k, n_probe, exact, skip_self, block_rows)


class CellIndex:
    """A collection ``(id, embedding, …)`` stored below ``path`` in one folder per cell."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, points: DataFrame, n_cells: int, seed: int = 42) -> "CellIndex":
        """Centres over all points, then all points in their cells; vectors that are computed are computed once."""
        points = materialised(points, "points")
        cells = fit_cells(points, n_cells, seed=seed)
        rows = [(i, c.tolist()) for i, c in enumerate(cells.centres)]
        self.spark.createDataFrame(rows, "cell int, centre array<double>").write.parquet(f"{self.path}/centres")
        return self.append(points)

    def append(self, points: DataFrame) -> "CellIndex":
        """Store more points in the cells of the centres there are; ids must be new, see ``KeyedStore`` for upserts."""
        celled = assign_rows(points, Cells(self._centres()), "embedding")
        # few files per cell, and a crowded cell in several tasks
        celled.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")
        # radii and numbers of rows from what was written: two narrow columns
        sizes_of(self.rows()).write.mode("overwrite").parquet(f"{self.path}/sizes")
        return self

    def _centres(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()
        return np.array([r["centre"] for r in rows], dtype=np.float64)

    def cells(self) -> Cells:
        return with_sizes(Cells(self._centres()), self.spark.read.parquet(f"{self.path}/sizes"))

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def rows_of(self, pairs: DataFrame) -> DataFrame:
        """Rows of the cells in ``pairs``: at most as many as there are cells, broadcast, prune the folders."""
        probed = pairs.where("cell >= 0").select("cell").distinct()
        return self.rows().join(F.broadcast(probed), "cell", "left_semi").select("id", F.col("embedding").alias("v"), "cell")

    def nearest(self, queries: DataFrame, k: int, n_probe: int = 4, exact: bool = True, query_id: str = "query_id", skip_self: bool = False, block_rows: int | None = None) -> DataFrame:
        """``(query_id, id, distance, rank)`` of the k nearest rows; of the n_probe best cells only, if not ``exact``."""
        asked = queries.select(F.col(query_id).alias("query_id"), F.col("embedding").alias("v"))
        return search_cells(asked, self.rows_of, self.cells(), k, n_probe, exact, skip_self, block_rows)

    def contents(self, hits: DataFrame, columns: tuple[str, ...] = ("document",)) -> DataFrame:
        """Columns of the rows that were hit."""
        return hits.join(self.rows().select("id", *columns), "id")
