"""Approximate nearest neighbours by multi-index hashing.

Vectors are turned into binary codes by ``ROTATIONS`` rotations, each learned on
a bounded sample of ``SAMPLE`` rows by iterative quantisation. Codes are cut into
substrings of eight bits; a block of rows keeps, for every substring and value,
the bitmap of its rows. Two codes within a radius r agree, by pigeonhole, up to
r // m bits in one of m substrings, so the union of the bitmaps of all values
that near holds every code within r. Their distances are counted, and what is
within the radius is ranked by inner product in double precision. The radius
comes from the sample: ``COVERAGE`` of its nearest neighbours lie within. A query
with fewer than k rows within it takes the block's k nearest codes instead, so
its answer is never short. Every row is indexed.

Inner products of vectors of different norms are brought to angles by one more
component that gives all rows the largest norm. Null, zero and non-finite
vectors take no part; rows that repeat an id count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.llm.vectors import matrix, one_per_id, search_blocks, usable

SAMPLE = 4096
SAMPLE_QUERIES = 256
ROTATIONS = 4
WIDEST = 64
STEPS = 20
COVERAGE = 0.98
CHUNK = 512
POPCOUNT = np.array([bin(v).count("1") for v in range(256)], dtype=np.uint8)
NEAR = POPCOUNT[np.arange(256)[:, None] ^ np.arange(256)]


def _rotation(points: np.ndarray, width: int, rng: np.random.Generator) -> np.ndarray:
    """Projection to principal directions, then the rotation that brings points closest to signs."""
    bits = min(WIDEST, width)
    basis = np.eye(width)[:, :bits]
    if len(points) > bits:
        _, vectors = np.linalg.eigh(points.T @ points)
        basis = vectors[:, ::-1][:, :bits]
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    projected = points @ basis
    for _ in range(STEPS if len(points) > bits else 0):
        u, _, v = np.linalg.svd(np.sign(projected @ turn).T @ projected)
        turn = (u @ v).T
    return basis @ turn


@dataclass
class Codes:
    """Rotations and radius for vectors of one length, with the norm rows are filled up to."""

    norm: float
    mean: np.ndarray
    rotations: list[np.ndarray]
    radius: int

    @classmethod
    def learn(cls, sample: np.ndarray, width: int, norm: float, k: int, seed: int = 11) -> "Codes":
        rng = np.random.default_rng(seed)
        made = cls(norm, np.zeros(width + 1), [], 0)
        points = made.filled(sample) if len(sample) else np.zeros((0, width + 1))
        if len(points):
            made.mean = points.mean(axis=0)
        made.rotations = [_rotation(points - made.mean, width + 1, rng) for _ in range(ROTATIONS)]
        if len(points) > 1:
            asked = sample[:SAMPLE_QUERIES]
            scores = asked @ sample.T
            np.fill_diagonal(scores, -np.inf)
            near = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
            distance = POPCOUNT[made.codes(asked, True)[:, None] ^ made.codes(sample, False)[near]].sum(axis=2, dtype=np.int64)
            made.radius = int(np.ceil(np.quantile(distance, COVERAGE)))
        return made

    def filled(self, vectors: np.ndarray) -> np.ndarray:
        scaled = vectors / self.norm
        rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(axis=1, keepdims=True)))
        return np.concatenate((scaled, rest), axis=1)

    def codes(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Codes as rows of bytes; a query is a direction and is not filled up."""
        if query:
            length = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
            points = np.concatenate((vectors / length, np.zeros((len(vectors), 1))), axis=1)
        else:
            points = self.filled(vectors)
        return np.packbits(np.concatenate([(points - self.mean) @ r > 0 for r in self.rotations], axis=1), axis=1)


def probe_tables(codes: np.ndarray, radius: int) -> np.ndarray:
    """For each substring and value, the bitmap of the rows whose substring is near enough by pigeonhole."""
    n, m = codes.shape
    reach, more = divmod(radius, m)
    tables = np.zeros((m, 256, (n + 7) // 8), np.uint8)
    for j in range(m):
        index = np.packbits(codes[:, j][None, :] == np.arange(256, dtype=np.uint8)[:, None], axis=1)
        limit = reach if j <= more else reach - 1
        values = np.unique(codes[:, j])
        for value in range(256):
            near = values[NEAR[value, values] <= limit] if limit >= 0 else values[:0]
            if len(near):
                tables[j, value] = np.bitwise_or.reduce(index[near], axis=0)
    return tables


def search_codes(asked: np.ndarray, codes: np.ndarray, radius: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query places, row places) of all codes within the radius, or of the k nearest where these are fewer."""
    tables = probe_tables(codes, radius)
    n = len(codes)
    for low in range(0, len(asked), CHUNK):
        part = asked[low : low + CHUNK]
        bitmap = tables[0, part[:, 0]].copy()
        for j in range(1, part.shape[1]):
            bitmap |= tables[j, part[:, j]]
        query, row = np.nonzero(np.unpackbits(bitmap, axis=1, count=n))
        width = -part.shape[1] % 8
        words, own = (np.ascontiguousarray(np.pad(x, ((0, 0), (0, width)))).view(np.uint64) for x in (part, codes))
        distance = np.zeros(len(query), np.int64)
        for w in range(own.shape[1]):
            distance += np.bitwise_count(words[query, w] ^ own[row, w])
        near = distance <= radius
        query, row = query[near], row[near]
        short = np.flatnonzero(np.bincount(query, minlength=len(part)) < min(k, n))
        if len(short):
            far = np.bitwise_count(words[short][:, None] ^ own[None]).sum(axis=2, dtype=np.int64)
            nearest = np.argsort(far, axis=1, kind="stable")[:, :k]
            kept = ~np.isin(query, short)
            query = np.concatenate((query[kept], np.repeat(short, nearest.shape[1])))
            row = np.concatenate((row[kept], nearest.ravel()))
        yield query + low, row


def fit(rows: DataFrame, k: int) -> dict[int, Codes]:
    """Codes for every length of vector, from a sample chosen by a hash of the id; norms are over all rows."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    norms = {r.width: r.norm for r in rows.groupBy(F.size("vector").alias("width")).agg(F.max(norm).alias("norm")).collect()}
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toLocalIterator():
        sample.setdefault(len(r.vector), []).append(r.vector)
    return {w: Codes.learn(np.array(sample.get(w, np.zeros((0, w)))), w, norms[w], k) for w in norms}


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): about the k largest inner products of every query, ``is_query`` over ``id``."""
    rows = one_per_id(usable(vectors, id_col, vector_col).where(F.exists("vector", lambda x: x != 0)))
    model = rows.sparkSession.sparkContext.broadcast(fit(rows, k))  # a few rotations, whatever the input

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.diff(batch.column(1).offsets.to_numpy())
            for width in np.unique(widths).tolist():
                own = batch.filter(pa.array(widths == width))
                codes = model.value[width].codes(matrix(own.column(1)), False)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "vector", "code"])

    def search(queries: pa.Table, own: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        asked, held = matrix(queries.column("vector")), matrix(own.column("vector"))
        query_ids, ids = queries.column("id").to_numpy(), own.column("id").to_numpy()
        made = model.value[asked.shape[1]]
        codes = np.frombuffer(b"".join(own.column("code").to_pylist()), np.uint8).reshape(len(held), -1)
        # one more than k, as a query may find itself
        for query, row in search_codes(made.codes(asked, True), codes, made.radius, k + 1):
            yield query_ids[query], ids[row], np.einsum("ij,ij->i", asked[query], held[row])

    schema = T.StructType([*rows.schema.fields, T.StructField("code", T.BinaryType())])
    return search_blocks(rows.mapInArrow(encode, schema), is_query, search, k, "double")
