"""Exact top-k search by columnar branch and bound.

Components are turned into integers floor(64 x). A block of rows stands in
vertical layout, component by component, those of the largest mass first. Inner
products are accumulated ``STEP`` components at a time. After each step the mass
that remains bounds what a row can still gain or lose (Cauchy-Schwarz); a row
whose upper bound is below the k-th best lower bound of its query is dropped, and
the survivors are compacted. What is left at the end has exact scores.

Null vectors and those with null or non-finite components take no part; zero
vectors do. Sums that may pass 2**53 are computed in Python integers; a score
beyond a long is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from hearth.llm.vectors import matrix, one_per_id, search_blocks, usable

SCALE = 64
STEP = 8
CHUNK = 128
EXACT = float(1 << 53)


def survivors(asked: np.ndarray, held: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query places, row places, scores) that hold the k largest of every query; integers in double precision."""
    order = np.argsort(-(held**2).sum(axis=0), kind="stable")
    asked, columns = asked[:, order], np.ascontiguousarray(held[:, order].T)
    width = len(order)
    query_rest = np.sqrt(np.cumsum((asked**2)[:, ::-1], axis=1)[:, ::-1])
    row_rest = np.sqrt(np.cumsum((columns**2)[::-1], axis=0)[::-1])
    for low in range(0, len(asked), CHUNK):
        part = asked[low : low + CHUNK]
        scores = np.zeros((len(part), columns.shape[1]))
        at = 0
        query = row = None
        while at < width:
            end = min(width, at + STEP)
            if query is None:
                scores += part[:, at:end] @ columns[at:end]
            else:
                for d in range(at, end):
                    scores += part[query, d] * columns[d, row]
            at = end
            if at == width:
                break
            # bounds are widened a little, as square roots are rounded
            if query is None:
                slack = query_rest[low : low + CHUNK, at][:, None] * row_rest[at][None, :] * (1 + 1e-9) + 1e-6
                lower = scores - slack
                limit = np.partition(lower, -k, axis=1)[:, -k][:, None] if lower.shape[1] > k else np.full((len(part), 1), -np.inf)
                alive = scores + slack >= limit
                if alive.mean() < 0.25:
                    query, row = np.nonzero(alive)
                    scores = scores[alive]
            else:
                slack = query_rest[low + query, at] * row_rest[at, row] * (1 + 1e-9) + 1e-6
                lower = scores - slack
                ranked = np.lexsort((-lower, query))
                starts = np.searchsorted(query[ranked], np.arange(len(part)))
                sizes = np.diff(np.append(starts, len(query)))
                limit = np.where(sizes >= k, lower[ranked[np.minimum(starts + k - 1, len(query) - 1)]], -np.inf)
                alive = scores + slack >= limit[query]
                query, row, scores = query[alive], row[alive], scores[alive]
        if query is None:
            kept = np.partition(scores, -k, axis=1)[:, -k][:, None] if scores.shape[1] > k else np.full((len(part), 1), -np.inf)
            query, row = np.nonzero(scores >= kept)
            scores = scores[query, row]
        yield query + low, row, scores


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of every query, ``is_query`` over ``id``."""
    rows = one_per_id(usable(vectors, id_col, vector_col))

    def search(queries: pa.Table, own: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        asked, held = np.floor(SCALE * matrix(queries.column("vector"))), np.floor(SCALE * matrix(own.column("vector")))
        query_ids, ids = queries.column("id").to_numpy(), own.column("id").to_numpy()
        if np.abs(asked).max() * np.abs(held).max() * asked.shape[1] < EXACT:
            # one more than k, as a query may find itself
            for query, row, scores in survivors(asked, held, k + 1):
                yield query_ids[query], ids[row], scores.astype(np.int64)
            return
        whole = [[[int(x) for x in v] for v in side] for side in (asked, held)]
        for i, q in enumerate(whole[0]):
            scores = [sum(a * b for a, b in zip(q, v, strict=True)) for v in whole[1]]
            if max(map(abs, scores)) >= 1 << 63:
                raise OverflowError("an inner product does not fit into a long")
            yield np.full(len(ids), query_ids[i]), ids, np.array(scores, dtype=np.int64)

    return search_blocks(rows, is_query, search, k, "long")
