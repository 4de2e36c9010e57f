"""Searches over tables whose ids repeat, against plain loops."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hearth.llm import hashing, topk
from hearth.llm.queries import ORACLE

K = 20


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    made = [(i, [float(x) for x in rng.normal(0, 1, 8)]) for i in range(150)]
    same = [made[0]] * 6 + [made[7]] * 40 + [made[40]] * 3
    other = [(i, [float(x) for x in rng.normal(0, 1, 8)]) for i in (20, 20, 33, 33, 60)]
    odd = [(None, made[1][1]), (20, None), (40, [1.0] * 7 + [math.nan]), (500, [0.0] * 8), (500, [0.0] * 8)]
    return [*made, *same, *other, *odd]


def brute(rows, whole, zeros):
    """One vector for every id, the least; all pairs."""
    kept = {}
    for i, v in rows:
        if i is None or v is None or not all(map(math.isfinite, v)) or not (zeros or any(v)):
            continue
        kept[i] = min(kept.get(i, v), v)
    if whole:
        kept = {i: [math.floor(64 * x) for x in v] for i, v in kept.items()}
    found = set()
    for q, v in kept.items():
        if q % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in kept.items() if i != q)[:K]
            found |= {(q, n, i, -s if whole else round(-s, 9)) for n, (s, i) in enumerate(near, 1)}
    return found


def test_exact_top_k_with_repeated_ids(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("width", F.lit("w")).repartition(5)
    found = [tuple(r) for r in topk.top_k(df, F.col("id") % 20 == 0, K).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, True, True)
    embeddings = df.where("vec_id IS NOT NULL").toPandas()  # the name the SQL reads
    embeddings["embedding"] = [None if v is None else list(v) for v in embeddings["embedding"]]
    assert {tuple(r) for r in duckdb.sql(ORACLE["op10_exact_top_k"]).fetchall()} == set(found)


def test_hashing_with_repeated_ids(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = hashing.nearest(df, F.col("id") % 20 == 0, K).collect()
    want = brute(rows, False, False)
    got = {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in found}
    asked = {q for q, *_ in want}
    for q in asked:
        own = [r.vec_id for r in found if r.query_id == q]
        assert len(own) == len(set(own)) == K and q not in own
    scores = {(q, i): s for q, _, i, s in want}
    assert {r.query_id for r in found} == asked
    assert len({(q, i) for q, _, i, _ in got} & set(scores)) >= 0.9 * len(scores)
    assert all(s == scores[q, i] for q, _, i, s in got if (q, i) in scores)
