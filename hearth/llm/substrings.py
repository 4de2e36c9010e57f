"""Substring dedup: count-min prefilter, then exact grouping.

Rows are dealt into bundles of bounded size. A bundle's count-min sketch holds,
for each of its distinct windows, one cell in each row of counters; it travels
as sorted cells with counts that stop at two, cut by ranges of cells, so that
the partial sketches are merged range by range and no task or driver holds the
whole array. The number of counters follows the number of bundles. Merged
counters never underestimate, so a window with one cell that counts once is
unique. Only the others go on to the second pass, which groups them exactly, by
a 128-bit digest of their words. Both passes answer a bundle with one bit per
window it asked about.

A null or empty text has no words. Texts shorter than a window lose nothing.
Repeated rows are documents of their own: all their windows repeat. Other
columns pass through; an input column named like a new one is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.llm.common import Places, bundle_count, raw, row_hash

WINDOW = 35
SKETCH_ROWS = 2
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = np.uint64(0xBF58476D1CE4E5B9)
REQUEST = "`__bundle` long, shard long, payload binary"
ANSWER = "`__bundle` long, shard long, n long, payload binary"


def window_codes(texts: list[bytes], window: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of every text, its number of windows, and two 64-bit codes of every window in order.

    A code is a polynomial over 64-bit digests of the words, put together from
    spans of one, two, four ... words and mixed at the end.
    """
    split = [t.split() for t in texts]
    known = Places()
    places = [np.fromiter(map(known.__getitem__, w), np.int64, len(w)) for w in split]
    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in known), dtype="<u8").reshape(-1, 2)
    counts = np.array([max(0, len(w) - window + 1) for w in split], dtype=np.int64)
    codes = np.empty((2, int(counts.sum())), np.uint64)
    at = 0
    for place, n in zip(places, counts.tolist(), strict=True):
        for side in range(2 if n else 0):
            total, span, length, taken, rest = np.zeros(n, np.uint64), digests[place, side], 1, 0, window
            while rest:
                shift = np.uint64(pow(FACTORS[side], length, 1 << 64))
                if rest & 1:
                    total = total * shift + span[taken : taken + n]
                    taken += length
                rest >>= 1
                if rest:
                    span = span[:-length] * shift + span[length:]
                    length *= 2
            total = (total ^ (total >> np.uint64(31))) * MIX
            codes[side, at : at + n] = total ^ (total >> np.uint64(29))
        at += n
    return split, counts, codes


def _grouped(values: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First position of each distinct value (pair), in order; how often it occurs; each entry's place among them."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if second is not None and len(values):
        other = second[order]
        if (~new[1:] & (other[1:] != other[:-1])).any():
            order = np.lexsort((second, values))
            ranked, other = values[order], second[order]
            new[1:] = (ranked[1:] != ranked[:-1]) | (other[1:] != other[:-1])
    starts = np.flatnonzero(new)
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[starts], np.diff(np.append(starts, len(values))), place


def _pack(low: np.ndarray, twice: np.ndarray, extra: np.ndarray | None = None) -> bytes:
    """Sorted numbers as differences, byte plane by byte plane, and whether each was seen twice."""
    steps = np.diff(low, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T)
    tail = b"" if extra is None else extra.astype("<u8").tobytes()
    return len(low).to_bytes(4, "little") + bytes([width]) + planes.tobytes() + np.packbits(twice).tobytes() + tail


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, width = int.from_bytes(data[:4], "little"), data[4]
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, n * width, 5).reshape(width, n).T
    flags = 5 + n * width
    twice = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, flags), count=n)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64), twice, np.frombuffer(data, "<u8", offset=flags + (n + 7) // 8)


def _requests(bundle: int, parts: list[tuple[np.ndarray, int, Callable[[int, int], bytes]]], shards: int) -> pa.Table:
    """One row per shard asked: ``parts`` holds sorted values, their number of bits, and what to send of a range."""
    found, payload = [], []
    for k, (values, bits, send) in enumerate(parts):
        bounds = np.array([(i << bits) // shards for i in range(1, shards)], dtype=np.uint64)
        edges = [0, *np.searchsorted(values, bounds).tolist(), len(values)]
        for s in range(shards):
            if edges[s] < edges[s + 1]:
                found.append(k * shards + s)
                payload.append(send(edges[s], edges[s + 1]))
    return pa.table({"__bundle": pa.array([bundle] * len(found), pa.int64()), "shard": pa.array(found, pa.int64()), "payload": pa.array(payload, pa.binary())})


def _answers(requests: pa.Table) -> pa.Table:
    """For the requests of one shard: whether each number (pair) was seen twice or more in all of them."""
    parts = [_unpack(p) for p in requests.column("payload").to_pylist()]
    second = np.concatenate([p[2] for p in parts])
    _, counts, place = _grouped(np.concatenate([p[0] for p in parts]), second if len(second) else None)
    total = counts + np.bincount(place, weights=np.concatenate([p[1] for p in parts]), minlength=len(counts))
    sizes = [len(p[0]) for p in parts]
    flags = np.split(total[place] > 1, np.cumsum(sizes)[:-1])
    return pa.table({
        "__bundle": requests.column("__bundle"),
        "shard": requests.column("shard"),
        "n": pa.array(sizes, pa.int64()),
        "payload": pa.array([np.packbits(f).tobytes() for f in flags], pa.binary()),
    })


def _bits(answers: pa.Table) -> np.ndarray:
    """Answers to one bundle in the order of its requests."""
    order = np.argsort(answers.column("shard").to_numpy()).tolist()
    data, sizes = answers.column("payload").to_pylist(), answers.column("n").to_pylist()
    parts = [np.unpackbits(np.frombuffer(data[i], np.uint8), count=sizes[i]) for i in order]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def repeated_words(docs: DataFrame, text_col: str, output: Callable, schema: T.StructType, window: int = WINDOW) -> DataFrame:
    """Both passes; ``output(table, words, masks)`` makes rows from a bundle's rows, their words and what repeats."""
    count = bundle_count(docs)
    shards = count // 4 + 1
    cell_bits = min(64, 23 + count.bit_length())
    dealt = docs.withColumn("__bytes", raw(text_col)).withColumn("__bundle", F.pmod(row_hash(docs), F.lit(count)))

    def cells(codes: np.ndarray) -> list[np.ndarray]:
        """The cell of every window in each row of the sketch: disjoint bits of its codes."""
        return [codes[k % 2] >> np.uint64(64 - cell_bits) for k in range(SKETCH_ROWS)]

    def sketch(table: pa.Table) -> pa.Table:
        _, _, codes = window_codes(table.column("__bytes").to_pylist(), window)
        parts = []
        for row in cells(codes):
            row.sort()
            starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
            twice = np.diff(np.append(starts, len(row))) > 1
            values = row[starts]
            parts.append((values, cell_bits, lambda a, b, values=values, twice=twice: _pack(values[a:b], twice[a:b])))
        return _requests(table.column("__bundle")[0].as_py(), parts, shards)

    def likely(codes: np.ndarray, answers: pa.Table) -> np.ndarray:
        """Positions of the windows that no row of the merged sketch shows to be unique."""
        bits, at, keep = _bits(answers), 0, np.ones(codes.shape[1], bool)
        for row in cells(codes):
            first, _, place = _grouped(row)
            keep &= bits[at : at + len(first)][place]
            at += len(first)
        return np.flatnonzero(keep)

    def exact(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _requests(0, [], shards)
        _, _, codes = window_codes(table.column("__bytes").to_pylist(), window)
        codes = codes[:, likely(codes, answers)]
        first, counts, _ = _grouped(codes[0], codes[1])
        low, high, twice = codes[0][first], codes[1][first], counts > 1
        return _requests(table.column("__bundle")[0].as_py(), [(low, 64, lambda a, b: _pack(low[a:b], twice[a:b], high[a:b]))], shards)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return output(table, [], [])
        words, windows, codes = window_codes(table.column("__bytes").to_pylist(), window)
        phase = answers.column("phase").to_numpy()
        asked = likely(codes, answers.filter(pa.array(phase == 1)))
        _, _, place = _grouped(codes[0][asked], codes[1][asked])
        starts = asked[_bits(answers.filter(pa.array(phase == 2)))[place]]
        masks, ends = [], np.cumsum(windows)
        for w, n, end in zip(words, windows.tolist(), ends.tolist(), strict=True):
            depth = np.zeros(len(w) + 1, np.int64)
            hit = starts[np.searchsorted(starts, end - n) : np.searchsorted(starts, end)] - (end - n)
            depth[hit] += 1
            depth[hit + window] -= 1
            masks.append(np.cumsum(depth[:-1]) > 0)
        return output(table, words, masks)

    by = dealt.groupBy("__bundle")
    first = by.applyInArrow(sketch, REQUEST).groupBy("shard").applyInArrow(_answers, ANSWER)
    asked = by.cogroup(first.groupBy("__bundle")).applyInArrow(exact, REQUEST)
    second = asked.groupBy("shard").applyInArrow(_answers, ANSWER)
    both = first.withColumn("phase", F.lit(1)).unionByName(second.withColumn("phase", F.lit(2)))
    return by.cogroup(both.groupBy("__bundle")).applyInArrow(finish, schema)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, text_col: str = "text", keep_space: bool = False) -> DataFrame:
    """``docs`` with words of repeated windows removed, and n_words, n_removed.

    Kept words are joined by one space; with ``keep_space`` a text that loses
    nothing stays as it is. A null text becomes empty, or stays null with ``keep_space``.
    """
    kept = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    own = docs.select(*[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(kept)])
    text = f"c_{kept.index(text_col)}"
    schema = T.StructType([*own.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def output(table: pa.Table, words: list[list[bytes]], masks: list[np.ndarray]) -> pa.Table:
        texts = []
        for original, tokens, gone in zip(table.column(text).to_pylist(), words, masks, strict=True):
            if keep_space and not gone.any():
                texts.append(original)
            else:
                texts.append(b" ".join([w for w, g in zip(tokens, gone.tolist(), strict=True) if not g]).decode())
        columns = {f"c_{i}": table.column(f"c_{i}") for i in range(len(kept))} | {text: pa.array(texts, pa.string())}
        columns |= {"n_words": pa.array([len(w) for w in words], pa.int64()), "n_removed": pa.array([int(g.sum()) for g in masks], pa.int64())}
        return pa.table(columns)

    found = repeated_words(own, text, output, schema, window)
    return found.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(kept)], "n_words", "n_removed")
