"""Numpy on one block of vectors; what a task of the nearest-neighbour operators runs.

Kept apart from the operators, so that Python workers load nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

DISTANCE_DECIMALS = 6
# cells of the distance matrix held at a time
CHUNK_CELLS = 1_000_000
# queries and points of one tile of a search, points of the first one
TILE = (1024, 4096)
FIRST_POINTS = 512
# single-precision candidates per hit beyond which a row is worked out in double precision
MANY_PER_HIT = 32
# candidates measured at a time
EXACT_ROWS = 1 << 16


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def with_vector(table, place: int):
    """Rows of a table or batch whose vector is there. Done here, since a filter in
    the plan would compute a derived vector a second time."""
    column = table.column(place)
    return table.filter(column.is_valid()) if column.null_count else table


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = (queries**2).sum(1)[:, None] + (points**2).sum(1)[None, :]
    gaps = squares - 2.0 * (queries @ points.T)
    return np.round(np.maximum(gaps, 0.0), DISTANCE_DECIMALS)


def _smallest(gaps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the k smallest numbers of every row, the first of equal ones; changes ``gaps``."""
    rows, found = np.arange(len(gaps)), []
    for _ in range(min(k, gaps.shape[1])):
        at = gaps.argmin(axis=1)
        found.append((rows, at, gaps[rows, at]))
        gaps[rows, at] = np.inf
    r, c, d = (np.concatenate(x) for x in zip(*found))
    return r[d < np.inf], c[d < np.inf], d[d < np.inf]


def _merge(best: np.ndarray, place: np.ndarray, r: np.ndarray, c: np.ndarray, d: np.ndarray) -> None:
    """Enter hits into the k best distances and columns of the rows they belong to."""
    k = best.shape[1]
    rows, at = np.unique(r, return_inverse=True)
    every = np.concatenate((np.repeat(np.arange(len(rows)), k), at))
    c, d = np.concatenate((place[rows].ravel(), c)), np.concatenate((best[rows].ravel(), d))
    order = np.lexsort((c, d, every))
    every = every[order]
    order = order[np.arange(len(every)) - np.searchsorted(every, every) < k]
    best[rows], place[rows] = d[order].reshape(-1, k), c[order].reshape(-1, k)


def k_best(queries: np.ndarray, points: np.ndarray, k: int, same: tuple[np.ndarray, np.ndarray] | None, times: tuple[np.ndarray, np.ndarray] | None = None,
           tile: tuple[int, int] = TILE, within: np.ndarray | None = None):
    """Row, column and distance of the k nearest points of every query.

    ``points`` must be in id order: equal distances are then settled by column.
    ``same`` holds codes of the unique ids of both sides; equal ids are left out.
    ``times`` holds whole numbers of both sides; only points of a smaller one count.
    ``within`` holds a distance per query that hits must not exceed.

    The product is worked out tile by tile, which stay in a core's cache, in single
    precision with a margin for its error; what lies within a query's k-th distance
    so far is measured again in double precision. A row with many such points, as
    many equal ones, is worked out in double precision as a whole.
    """
    if not len(queries) or not len(points) or k < 1:
        return np.array([], int), np.array([], int), np.array([], float)
    query_squares, point_squares = (queries**2).sum(1), (points**2).sum(1)
    largest = point_squares[np.isfinite(point_squares)].max(initial=0.0)
    # a norm near the largest single number is left to double precision
    single = max(largest, query_squares[np.isfinite(query_squares)].max(initial=0.0)) < 1e30
    with np.errstate(over="ignore", invalid="ignore"):
        left = np.column_stack((queries, np.ones(len(queries)))).astype(np.float32)
        right = np.column_stack((-2.0 * points, point_squares)).astype(np.float32)
        # rounding may turn a near miss into a tie, and single precision loses some bits of every term
        margin = 2 * 10.0**-DISTANCE_DECIMALS + 2.0**-22 * (queries.shape[1] + 8) * (query_squares + largest)
    own = None
    if same is not None:
        places = np.full(max(same[0].max(initial=-1), same[1].max(initial=-1)) + 1, -1)
        places[same[1]] = np.arange(len(points))
        own = places[same[0]]
    # few points first, so that most of them are compared with a distance that is known
    edges, step = [0], min(tile[1], FIRST_POINTS)
    while edges[-1] < len(points):
        edges.append(min(edges[-1] + step, len(points)))
        step = min(tile[1], 2 * step)
    rows, cols, dists = [], [], []
    for low in range(0, len(queries), tile[0]):
        part = slice(low, min(low + tile[0], len(queries)))
        mine, q = np.arange(part.start, part.stop), query_squares[part]
        best, place = np.full((len(mine), k), np.inf), np.full((len(mine), k), len(points))
        limit = np.full(len(mine), np.inf) if within is None else within[part].astype(float)
        for first, last in zip(edges, edges[1:]):
            near = np.minimum(limit, best[:, -1])
            known = np.isfinite(near) if single else np.zeros(len(mine), bool)

            def excluded(gaps: np.ndarray, of: np.ndarray) -> np.ndarray:
                if own is not None:
                    at = own[mine[of]] - first
                    inside = np.flatnonzero((at >= 0) & (at < last - first))
                    gaps[inside, at[inside]] = np.inf
                if times is not None:
                    gaps[times[1][None, first:last] >= times[0][mine[of]][:, None]] = np.inf
                return gaps

            found, heavy = [], np.flatnonzero(~known)
            if known.any():
                with np.errstate(over="ignore", invalid="ignore"):
                    gaps = excluded(left[part] @ right[first:last].T, np.arange(len(mine)))
                    bound = np.where(known, near - q + margin[part], -np.inf)
                r, c = np.divmod(np.flatnonzero(gaps <= bound[:, None].astype(np.float32)), last - first)
                per_row = np.bincount(r, minlength=len(mine))
                many = per_row > MANY_PER_HIT * k
                if many.any():
                    heavy = np.union1d(heavy, np.flatnonzero(many))
                    r, c = r[~many[r]], c[~many[r]]
                if len(r):
                    dots = np.concatenate([
                        np.einsum("ij,ij->i", queries[mine[r[x : x + EXACT_ROWS]]], points[first + c[x : x + EXACT_ROWS]]) for x in range(0, len(r), EXACT_ROWS)
                    ])
                    found.append((r, c, np.round(np.maximum(q[r] + point_squares[first + c] - 2.0 * dots, 0.0), DISTANCE_DECIMALS)))
            if len(heavy):
                with np.errstate(over="ignore", invalid="ignore"):
                    gaps = distances(queries[mine[heavy]], points[first:last])
                gaps[np.isnan(gaps)] = np.inf
                r, c, d = _smallest(excluded(gaps, heavy), k)
                found.append((heavy[r], c, d))
            if found:
                r, c, d = (np.concatenate(x) for x in zip(*found))
                keep = d <= near[r]
                if keep.any():
                    _merge(best, place, r[keep], c[keep] + first, d[keep])
        r, j = np.nonzero(best < np.inf)
        rows.append(mine[r])
        cols.append(place[r, j])
        dists.append(best[r, j])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dists)


def codes_of(left: pd.Series, right: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    codes, _ = pd.factorize(pd.concat([left, right], ignore_index=True))
    return codes[: len(left)], codes[len(left) :]


def by_key(left: pd.Series, right: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of both sides for every key of the left side."""
    lc, rc = codes_of(left, right)
    lo, ro = np.argsort(lc, kind="stable"), np.argsort(rc, kind="stable")
    ls, rs = lc[lo], rc[ro]
    for code in np.unique(ls):
        yield (
            lo[np.searchsorted(ls, code) : np.searchsorted(ls, code, "right")],
            ro[np.searchsorted(rs, code) : np.searchsorted(rs, code, "right")],
        )
