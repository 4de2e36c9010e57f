import numpy as np
import pytest

from hearth.operators import cells as K
from hearth.operators import nearest as N


def frame(spark, ids, vectors, users=None, id_type="long"):
    users = users if users is not None else [0] * len(ids)
    rows = [(i, None if v is None else [float(x) for x in v], int(u)) for i, v, u in zip(ids, vectors, users)]
    return spark.createDataFrame(rows, f"id {id_type}, embedding array<float>, user_id int")


def brute(queries, points, k, users=None, skip_self=False):
    """Ids are row numbers. Sorted (query, rank, id)."""
    q, p = (np.asarray(x, dtype=np.float32).astype(float) for x in (queries, points))
    out = []
    for i, v in enumerate(q):
        d = np.round(((p - v) ** 2).sum(1), 6)
        found = [
            (d[j], j)
            for j in range(len(p))
            if not (skip_self and i == j) and (users is None or users[0][i] == users[1][j])
        ]
        out += [(i, r + 1, j) for r, (_, j) in enumerate(sorted(found)[:k])]
    return out


def answer(hits):
    return sorted((r["query_id"], r["rank"], r["id"]) for r in hits.collect())


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    points = rng.normal(size=(300, 8))
    points[100:200] = points[100]  # a third of the rows are copies
    return points


WAYS = [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "block_rows": 37}]


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("skip_self", [False, True])
def test_exact(spark, data, way, skip_self):
    f = frame(spark, range(len(data)), data)
    expected = brute(data, data, 4, skip_self=skip_self)
    for parts in (1, 6):
        hits = N.nearest(f, f.repartition(parts), 4, "id", skip_self=skip_self, **way)
        assert answer(hits) == expected


@pytest.mark.parametrize("block_rows", [20, 10_000])
def test_exact_by_user(spark, data, block_rows):
    """One user owns most rows; with small blocks that user is split."""
    users = np.where(np.arange(len(data)) % 5 == 0, np.arange(len(data)) % 7 + 1, 0)
    f = frame(spark, range(len(data)), data, users)
    hits = N.nearest(f, f, 3, "id", by="user_id", skip_self=True, block_rows=block_rows)
    assert answer(hits) == brute(data, data, 3, (users, users), True)


def test_more_neighbours_than_points(spark, data):
    f = frame(spark, range(5), data[:5])
    for way in WAYS:
        assert answer(N.nearest(f, f, 50, "id", **way)) == brute(data[:5], data[:5], 50)


def test_missing_vectors_and_text_ids(spark):
    points = frame(spark, ["b", "a", "c"], [[1, 0], [1, 0], None], id_type="string")
    queries = frame(spark, ["q", "r"], [[1, 0], None], id_type="string")
    for way in WAYS:
        assert answer(N.nearest(queries, points, 2, "id", **way)) == [("q", 1, "a"), ("q", 2, "b")]
    empty = points.filter("id = 'none'")
    for way in WAYS:
        assert answer(N.nearest(queries, empty, 2, "id", **way)) == []
        assert answer(N.nearest(empty, points, 2, "id", **way)) == []


def test_distance_and_relevance(spark):
    from hearth.functions.vectors import relevance, squared_distance

    rows = spark.createDataFrame([([1.0, 0.0], [0.37, (1 - 0.37**2) ** 0.5])], "a array<double>, b array<double>")
    distance = squared_distance("a", "b")
    got = rows.select(distance, relevance(distance)).first()
    assert tuple(got) == pytest.approx((1.26, -0.26))


@pytest.mark.parametrize("n_probe", [1, 3])
def test_clustered_exact(spark, data, n_probe):
    f = frame(spark, range(len(data)), data)
    hits = K.nearest_clustered(f, f, 4, 6, n_probe, True, "id", skip_self=True, block_rows=50)
    assert answer(hits) == brute(data, data, 4, skip_self=True)


def test_clustered_recall(spark, data):
    f = frame(spark, range(len(data)), data)
    truth = N.nearest(f, f, 4, "id")
    full = K.nearest_clustered(f, f, 4, 6, 6, False, "id")
    assert N.recall(full, truth).first()["recall"] == 1.0
    part = K.nearest_clustered(f, f, 4, 6, 1, False, "id")
    assert 0 < N.recall(part, truth).first()["recall"] <= 1.0


def test_no_all_pairs_join(spark, data):
    f = frame(spark, range(20), data[:20])
    for way in WAYS:
        plan = N.nearest(f, f, 3, "id", **way)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert "WindowGroupLimit" in plan


def test_many_batches_per_task(spark, data):
    f = frame(spark, range(len(data)), data)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, "16")
    try:
        hits = N.nearest(f, f.coalesce(1), 4, "id", skip_self=True)
        assert answer(hits) == brute(data, data, 4, skip_self=True)
    finally:
        spark.conf.set(name, old)


def test_blocks_follow_the_pairs_of_rows(spark):
    """Some millions of pairs make one block, hundreds of millions several, whatever the rows of one product."""
    from hearth.operators.nearest import _block_rows, _blocked

    def blocks(n):
        f = spark.range(n).selectExpr("id", "array(1f, 2f) AS embedding")
        sides = _blocked(f, f, ["id"], ["id"], None, _block_rows(f, "embedding", None, None))
        return [side.select("_lb", "_rb").distinct().count() for side in sides]

    assert blocks(1000) == [1, 1]
    several = blocks(20_000)
    assert several[0] == several[1] >= 2


def test_small_products_copy_no_rows(spark, monkeypatch):
    """The rows of a matrix product do not decide how often rows are shuffled."""
    seen, cut = [], N._blocked
    monkeypatch.setattr(N, "_blocked", lambda *args: seen.append(args[-1]) or cut(*args))
    f = spark.range(3000).selectExpr("id", "array(float(id), 2f) AS embedding")
    got = answer(N.nearest(f, f, 2, "id", skip_self=True, broadcast_bytes=0, block_rows=100))
    assert [r for r in got if r[0] == 1500] == [(1500, 1, 1499), (1500, 2, 1501)]
    assert seen[0] >= 3000


@pytest.mark.parametrize("tile", [(1024, 4096), (7, 5)])
def test_kernel_against_sorting(tile):
    """Many equal points, missing components, large numbers and given distances."""
    from hearth.functions.blocks import distances, k_best

    rng = np.random.default_rng(3)
    for points in (rng.integers(0, 3, (700, 4)).astype(float), rng.normal(size=(700, 16)) * 1e4, np.ones((700, 3)), rng.normal(size=(700, 4)) * 1e17):
        queries = points[rng.integers(0, 700, 50)] + 0.0
        queries[3, 0], points[5, 1] = np.nan, np.nan
        d = distances(queries, points)
        within = np.where(np.arange(50) % 2 == 0, np.inf, 2.0)
        d[np.isnan(d) | (d > within[:, None])] = np.inf
        expected = [(i, j) for i in range(50) for j in np.argsort(d[i], kind="stable")[:6] if d[i, j] < np.inf]
        r, c, found = k_best(queries, points, 6, None, tile=tile, within=within)
        if points[0, 0] < 1e9 and points[0].size == 16:
            assert np.allclose(found, [d[i, j] for i, j in expected], rtol=1e-9, atol=1e-5)
        else:
            assert list(zip(r, c)) == expected
