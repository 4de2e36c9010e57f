"""SimHash near-dedup with bit-sliced comparison.

A fingerprint sets a bit where over half of a text's shingle hashes set it.
Fingerprints within ``radius`` differing bits are linked; a document's class is
what links reach. Inside a bucket of candidates 64 fingerprints stand in one
machine word per bit plane; carry-save counters add up 64 distances at once, and
a word is abandoned when all its counters have passed the radius. A bucket
leaves a spanning star, never its pairs.

Fingerprints are looked up without loss: by pigeonhole, two within the radius
share one of radius + 1 blocks of bits and, within the rest, one of radius + 1
blocks again.

Null and empty texts have no words and the fingerprint zero, linked like any
other. Repeated rows and texts share a fingerprint, which is compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.llm.common import append_columns, bound_batches, written
from hearth.llm.components import connected_components

SEED = 42
WORD = 64
TILE = 8192
CHUNK = 1 << 18
SLICE = 1 << 15


def _hashes(joined: bytes, spans: list[tuple[int, int]]) -> np.ndarray:
    """Hashes of pieces of a text as rows of bytes, lowest bits first."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8").view(np.uint8).reshape(-1, 8)


def fingerprint(text: bytes, words: int) -> np.ndarray:
    """Fingerprint of a text's shingles, repeats included, as one 64-bit word."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(1, "<u8")
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: max(1, len(tokens) - words + 1)]
    ends = ends[min(words, len(tokens)) - 1 :]
    counts = np.zeros(WORD, np.int64)
    for low in range(0, len(starts), SLICE):
        spans = list(zip(starts[low : low + SLICE].tolist(), ends[low : low + SLICE].tolist(), strict=True))
        counts += np.unpackbits(_hashes(joined, spans), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, words: int, text_col: str = "text") -> DataFrame:
    """``docs`` and fp, the fingerprint of each row's text as little-endian bytes."""

    def compute(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array([fingerprint(t, words).tobytes() for t in texts], pa.binary())]

    return append_columns(docs, text_col, compute, [("fp", T.BinaryType())])


def hex_digits(column: str) -> Column:
    """A 64-bit fingerprint as 16 hex digits, highest first."""
    digits = F.lower(F.hex(column))
    return F.concat(*[F.substring(digits, at, 2) for at in range(15, 0, -2)])


def _cut(width: int, parts: int) -> list[tuple[int, int]]:
    """(shift, bits) of ``parts`` nearly equal blocks of a number of ``width`` bits."""
    edges = [width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def pigeonhole_keys(fps: np.ndarray, radius: int) -> np.ndarray:
    """One column of keys per pair of blocks; two 64-bit numbers within the radius agree in one column at least."""
    columns = []
    one = np.uint64(1)
    for i, (shift, bits) in enumerate(_cut(WORD, radius + 1)):
        value = (fps >> np.uint64(shift)) & ((one << np.uint64(bits)) - one)
        low = fps & ((one << np.uint64(shift)) - one)
        high = fps >> np.uint64(shift + bits) if shift + bits < WORD else np.zeros_like(fps)
        rest = low | (high << np.uint64(shift) if shift < WORD else high)
        for j, (inner, width) in enumerate(_cut(WORD - bits, radius + 1)):
            part = (rest >> np.uint64(inner)) & ((one << np.uint64(width)) - one)
            columns.append((np.uint64(i * (radius + 1) + j) << np.uint64(bits + width)) | (value << np.uint64(width)) | part)
    return np.stack(columns, axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Fingerprints of a binary column as rows of 64-bit words."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<u8").reshape(len(rows), -1)


def _lanes(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs of rows: first lane of each run, and lane and bit position of each row."""
    lanes = -(-sizes // 64)
    first = np.concatenate(([0], np.cumsum(lanes)[:-1]))
    within = np.arange(sizes.sum()) - np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    return first, np.repeat(first, sizes) + within // 64, within % 64


def near_pairs(fps: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row index pairs at a distance of at most ``radius`` inside each run of ``sizes`` consecutive rows of words."""
    first, lane, place = _lanes(sizes)
    n_lanes = int(lane[-1]) + 1
    one, full = np.uint64(1), ~np.uint64(0)
    place = place.astype(np.uint64)
    heads = np.flatnonzero(np.concatenate(([True], lane[1:] != lane[:-1])))
    bits = WORD * fps.shape[1]
    plane = [(fps[:, b // WORD] >> np.uint64(b % WORD)) & one for b in range(bits)]
    planes = [np.bitwise_or.reduceat(p << place, heads) for p in plane]
    used = np.bitwise_or.reduceat(one << place, heads)
    last = np.repeat(first + -(-sizes // 64), sizes)
    todo = last - lane
    width = radius.bit_length()
    bias = (1 << width) - 1 - radius
    start = 0
    reach = np.cumsum(todo)
    while start < len(fps):
        stop = max(start + 1, int(np.searchsorted(reach, (reach[start - 1] if start else 0) + CHUNK, "right")))
        count = todo[start:stop]
        rows = np.repeat(np.arange(start, stop), count)
        offset = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        lanes = lane[rows] + offset
        over = ~used[lanes]
        counters = [np.full(len(rows), full if bias >> k & 1 else np.uint64(0)) for k in range(width)]
        for b in range(bits):
            carry = planes[b][lanes] ^ (np.uint64(0) - plane[b][rows])
            for k in range(width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if b % 4 == 3:
                alive = over != full
                if not alive.all():
                    rows, lanes, over = rows[alive], lanes[alive], over[alive]
                    counters = [c[alive] for c in counters]
                if not len(rows):
                    break
        if len(rows):
            hit = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            which, bit = np.nonzero(hit)
            other = heads[lanes[which]] + bit
            keep = other > rows[which]
            if keep.any():
                yield rows[which][keep], other[keep]
        start = stop


def _roots(n: int, fps: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """Least row index each row is linked to inside its run."""
    label = np.arange(n)
    for a, b in near_pairs(fps, sizes, radius):
        while True:
            x, y = label[a], label[b]
            if (x == y).all():
                break
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(label, high, low)
            while (label != label[label]).any():
                label = label[label]
    return label


def _links_of(key: np.ndarray, nodes: np.ndarray, fps: np.ndarray, radius: int) -> pa.RecordBatch:
    edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((edges, [len(key)])))
    keep = np.repeat(sizes > 1, sizes)
    nodes, fps, sizes = nodes[keep], fps[keep], sizes[sizes > 1]
    a = b = np.zeros(0, np.int64)
    if len(fps):
        root = _roots(len(fps), fps, sizes, radius)
        moved = root != np.arange(len(fps))
        a, b = nodes[moved], nodes[root[moved]]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between the nodes of distinct fingerprints (node, fp); their components are those of all links.

    A bucket of over ``TILE`` fingerprints is cut into tiles, and every pair of
    tiles becomes a bucket of its own, so no group has to fit into one task.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                rows = _matrix(part.column(1))
                keys = pigeonhole_keys(rows[:, 0], radius)
                again = np.repeat(np.arange(len(rows)), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), part.column(0).take(pa.array(again)), part.column(1).take(pa.array(again))], ["key", "node", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2)))
            held = part if held is None else tuple(np.concatenate(pair) for pair in zip(held, part, strict=True))
            whole = int(np.searchsorted(held[0], held[0][-1], "left")) if len(held[0]) else 0
            if whole:
                yield _links_of(*(x[:whole] for x in held), radius)
                held = tuple(x[whole:] for x in held)
        if held is not None and len(held[0]):
            yield _links_of(*held, radius)

    bound_batches(fps.sparkSession)
    keyed = fps.select("node", "fp").mapInArrow(spread, "key long, node long, fp binary")
    large = keyed.groupBy("key").count().where(F.col("count") > TILE).select("key", F.ceil(F.col("count") / TILE).alias("tiles"))
    tiled = keyed.join(large, "key", "left").withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")))
    other = F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    pairs = tiled.withColumn("other", other).select(
        F.when(F.col("tiles").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).alias("key"), "node", "fp"
    )
    return pairs.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")


def classes(rows: DataFrame, radius: int, id_col: str = "doc_id") -> DataFrame:
    """(fp, component_id): the least id among all rows that links reach from a fingerprint."""
    distinct = written(rows.groupBy("fp").agg(F.min(id_col).alias("first")).withColumn("node", F.xxhash64("fp")), "fingerprints")
    nodes = connected_components(links(distinct, radius))
    rooted = distinct.join(nodes, "node", "left").select("fp", "first", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, component_id): one row per row of ``docs`` with its class."""
    rows = written(fingerprints(docs.select(id_col, text_col), words, text_col).select(id_col, "fp"), "rows")
    return rows.join(classes(rows, radius, id_col), "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the first of the least id, a null id before all others.

    Rows are written once with their fingerprint and number, so that later jobs see the same numbers.
    """
    own = docs.select(*[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(docs.columns)])
    names = dict(zip(docs.columns, own.columns, strict=True))
    rows = written(fingerprints(own, words, names[text_col]).withColumn("row", F.monotonically_increasing_id()), "rows")
    keyed = rows.select("fp", F.struct(F.col(names[id_col]).alias("id"), "row").alias("key"))
    chosen = classes(keyed, radius, "key").select(F.col("component_id.row").alias("row")).distinct()
    return rows.join(chosen, "row", "left_semi").select(*[F.col(c).alias(n) for n, c in names.items()])
