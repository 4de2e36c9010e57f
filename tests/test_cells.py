import numpy as np
import pytest
from pyspark.sql import functions as F

from hearth.operators import cells as K
from hearth.operators import nearest as N
from hearth.plans import jobs
from hearth.session import scratch_path


def groups_of(spark, n=600, kinds=12, seed=4):
    """Points around a few far centres, so that cells can be left out."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(kinds, 8)) * 10
    points = middles[rng.integers(0, kinds, n)] + rng.normal(size=(n, 8)) * 0.3
    rows = [(i, v.tolist(), f"text {i}") for i, v in enumerate(points)] + [(n, None, "no vector")]
    return spark.createDataFrame(rows, "id long, embedding array<double>, document string").repartition(3)


def sorted_rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in df.collect())


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def stored(spark):
    points = groups_of(spark)
    index = K.CellIndex(spark, scratch_path(spark, "cells")).build(points.where("id % 3 > 0 or embedding is null"), 12)
    return points, index.append(points.where("id % 3 = 0"))


def test_index_with_appended_rows_equals_exact_search(spark, stored):
    points, index = stored
    queries = points.where("id % 7 = 0").withColumnRenamed("id", "query_id")
    truth = sorted_rows(N.nearest(queries, points, 4))
    assert index.rows().count() == 600
    assert sorted_rows(index.nearest(queries, 4, n_probe=1)) == truth
    assert sorted_rows(index.nearest(queries, 4, n_probe=1, block_rows=20)) == truth
    part = index.nearest(queries, 4, n_probe=2, exact=False)
    assert N.recall(part, N.nearest(queries, points, 4)).first()["recall"] >= 0.9
    assert sorted_rows(index.nearest(queries, 4, n_probe=1, skip_self=True)) == sorted_rows(N.nearest(queries, points, 4, skip_self=True))


def test_only_cells_that_can_hold_a_hit_leave_the_task(spark, stored):
    points, index = stored
    cells = index.cells()
    assert int(cells.rows.sum()) == 600
    queries = points.where("id % 7 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("v"))
    near = queries.withColumn("reach", F.lit(2.0))
    pairs = K.expand(near, cells, 0, len(cells.centres)).collect()
    assert len(pairs) < 3 * queries.count()
    # every row within reach lies in an expanded cell
    kept = {(r["query_id"], r["cell"]) for r in pairs}
    rows = [(r["id"], np.array(r["embedding"]), r["cell"]) for r in index.rows().collect()]
    for q in queries.collect():
        for _, v, cell in rows:
            if np.linalg.norm(np.array(q["v"]) - v) <= 2.0:
                assert (q["query_id"], cell) in kept


def test_folders_of_other_cells_are_pruned(spark, stored):
    _, index = stored
    pairs = spark.createDataFrame([(1, [0.0] * 8, 2), (2, [0.0] * 8, 5)], "query_id long, v array<double>, cell int")
    found = index.rows_of(pairs)
    assert {r["cell"] for r in found.select("cell").distinct().collect()} <= {2, 5}
    assert "dynamicpruning" in plan_of(found).lower()


def test_contexts_from_the_index(spark, stored):
    points, index = stored
    queries = points.where("id < 5").select(F.col("id").alias("query_id"), "embedding")
    hits = {(r["query_id"], r["rank"]): r["document"] for r in jobs.retrieve_contexts(queries, index, 3).collect()}
    assert len(hits) == 15 and all(hits[q, 1] == f"text {q}" for q in range(5))


def test_more_hits_wanted_than_a_cell_has(spark, stored):
    points, index = stored
    queries = points.where("id < 3").select(F.col("id").alias("query_id"), "embedding")
    assert sorted_rows(index.nearest(queries, 200, n_probe=1)) == sorted_rows(N.nearest(queries, points, 200))


def test_bounded_centres():
    with pytest.raises(ValueError):
        K.Cells(np.broadcast_to(np.zeros(1), (1 << 20, 64)))


def test_build_computes_vectors_once(spark):
    """Fitting and storing read the vectors back, however often k-means goes over them."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def counted(n):
        calls.add(1)
        return [float(n % 7), float(n % 11)]

    points = spark.range(200).repartition(2).select("id", counted("id").alias("embedding"))
    index = K.CellIndex(spark, scratch_path(spark, "once")).build(points, 4)
    assert calls.value == 200
    assert index.rows().count() == 200
