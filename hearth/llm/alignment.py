"""Alignment of two tokenizers' tokens by the bytes they cover.

Both sides of a text cover the same bytes. Per batch ``pandas.merge_asof``, keyed
by document, finds for every token start the token of the other side that covers
it; the union of both directions is every overlapping pair, since of two tokens
that overlap the one that starts later starts inside the other. Offsets where
tokens of both sides end cut the text into groups.

How many documents hold an id pair is counted over the whole corpus: a task
numbers the distinct pairs of a bundle of documents, so that a pair travels once
per bundle with its count of documents; the counts are summed, marked where they
are the highest of their first id, and returned to the bundles. No key has more
rows than there are bundles.

A null or empty text, and one whose tokens' joined bytes differ from a space and
the text, has no tokens: all its numbers are zero and its digest empty. Repeated
rows are documents of their own. Other columns are ignored. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.llm.byte_bpe import byte_bpe_of
from hearth.llm.common import bound_batches, packed, raw, unpacked, written
from hearth.llm.pieces import BYTE, MARKER, read_model

GROUP_BYTES = 1 << 20
BUNDLE_PAIRS = 2_000_000
ROW_PAIRS = 65_536


class Sides:
    """Both tokenizers: ids of texts, and the bytes of ids as arrays to take from."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = byte_bpe_of(path_a, True), SentencePieceProcessor(model_file=path_b)
        bytes_a = self.a.token_bytes()
        bytes_b = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(MARKER, " ").encode() for p in read_model(path_b).pieces]
        self.tables = [pa.array(t, pa.large_binary()) for t in (bytes_a, bytes_b)]
        self.sizes = [np.array([len(x) for x in t], np.int64) for t in (bytes_a, bytes_b)]
        self.marked = pa.array([f"{i}{mark}" for i in range(max(len(bytes_a), len(bytes_b))) for mark in ",|;"], pa.large_string())

    def ids(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        decoded = [t.decode() for t in texts]
        found = [self.a.encode(" " + t) for t in decoded], [np.array(ids, np.uint32) for ids in self.b.encode(decoded, num_threads=1)]
        for n, text in enumerate(texts):
            if not text or any(self.joined(side, ids[n]) != b" " + text for side, ids in enumerate(found)):
                found[0][n] = found[1][n] = np.zeros(0, np.uint32)
        return found

    def joined(self, side: int, ids: np.ndarray) -> bytes:
        taken = self.tables[side].take(pa.array(ids))
        return taken.buffers()[2].to_pybytes() if len(ids) else b""

    def groups_text(self, ids: tuple[np.ndarray, np.ndarray], group: tuple[np.ndarray, np.ndarray], edges: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """``a1,a2|b1;`` and so on of all documents, and the byte offset where each document's text ends."""
        (a, b), (group_a, group_b) = ids, group
        marks = np.empty(len(a) + len(b), np.int64)
        last_a = np.append(group_a[1:] != group_a[:-1], True)[: len(a)]
        last_b = np.append(group_b[1:] != group_b[:-1], True)[: len(b)]
        # tokens of the other side that stand before each group's own
        before_a = np.cumsum(np.bincount(group_b, minlength=1)) - np.bincount(group_b, minlength=1)
        upto_b = np.cumsum(np.bincount(group_a, minlength=1))
        marks[np.arange(len(a)) + before_a[group_a]] = a.astype(np.int64) * 3 + last_a
        marks[np.arange(len(b)) + upto_b[group_b]] = b.astype(np.int64) * 3 + 2 * last_b
        taken = self.marked.take(pa.array(marks))
        offsets = np.frombuffer(taken.buffers()[1], np.int64)
        return memoryview(taken.buffers()[2] or b""), offsets[edges]


@lru_cache(maxsize=1)
def sides_of(path_a: str, path_b: str) -> Sides:
    return Sides(path_a, path_b)


def covering(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """For each token of ``left`` the number of the token of ``right`` that covers its start."""
    return pd.merge_asof(left, right.assign(other=np.arange(len(right))), on="start", by="doc")["other"].to_numpy()


def overlaps(doc_a: np.ndarray, start_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (a, b) of all pairs of tokens that overlap; starts ascend over the whole batch."""
    a, b = pd.DataFrame({"doc": doc_a, "start": start_a}), pd.DataFrame({"doc": doc_b, "start": start_b})
    over_a, over_b = covering(a, b), covering(b, a)
    # tokens that start together have found each other in both directions
    new = start_a[over_b] != start_b if len(over_b) else np.zeros(0, bool)
    return np.append(np.arange(len(over_a)), over_b[new]), np.append(over_a, np.flatnonzero(new))


def _groups(n: int, ends: np.ndarray) -> np.ndarray:
    """Group of each of n tokens, whose groups end with the tokens ``ends``."""
    last = np.zeros(n, np.int64)
    last[ends] = 1
    return np.cumsum(last) - last


class Aligned:
    """A group of texts aligned: numbers per document and the links of all."""

    def __init__(self, sides: Sides, texts: list[bytes], shift: int):
        ids = sides.ids(texts)
        counts = [np.array([len(x) for x in side], np.int64) for side in ids]
        a, b = (np.concatenate([np.zeros(0, np.uint32), *side]) for side in ids)
        doc = [np.repeat(np.arange(len(texts)), n) for n in counts]
        size = [sides.sizes[0][a], sides.sizes[1][b]]
        end = [np.cumsum(s) for s in size]
        start = [e - s for e, s in zip(end, size, strict=True)]
        _, *common = np.intersect1d(*end, assume_unique=True, return_indices=True)
        group = tuple(_groups(len(e), at) for e, at in zip(end, common, strict=True))
        edges = np.concatenate(([0], np.cumsum(counts[0] + counts[1])))
        text, at = sides.groups_text((a, b), group, edges)
        self.digests = [hashlib.sha256(text[low : high - 1]).hexdigest() if high > low else "" for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        self.n_a, self.n_b = counts
        bounds = np.concatenate(([0], np.cumsum(counts[0])))
        last = np.where(counts[0] > 0, group[0][np.minimum(bounds[1:] - 1, len(a) - 1)] + 1, 0) if len(a) else np.zeros(len(texts), np.int64)
        tops = np.maximum.accumulate(last)
        self.n_groups = np.diff(np.concatenate(([0], tops)))
        left, right = overlaps(doc[0], start[0], doc[1], start[1])
        owner = doc[0][left]
        self.n_links = np.bincount(owner, minlength=len(texts))
        pair = (a[left].astype(np.int64) << shift) | b[right]
        # the pairs of one document after the other, each once with the number of its links
        order = np.lexsort((pair, owner))
        pair, owner = pair[order], owner[order]
        heads = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1]))) if len(pair) else np.zeros(0, np.int64)
        self.pairs, self.times = pair[heads], np.diff(np.append(heads, len(pair)))
        self.cuts = np.concatenate(([0], np.cumsum(np.bincount(owner[heads], minlength=len(texts)))))


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def _bundles(docs: DataFrame, id_col: str, text_col: str, path_a: str, path_b: str, shift: int) -> DataFrame:
    """Rows of documents (at and times: their pairs as numbers within the bundle, and links of each) and of pairs."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"bundle long, id {kind}, {', '.join(f'{n} long' for n in NUMBERS)}, groups_sha256 string, at binary, times binary, pairs array<long>, docs array<long>"
    names = ["bundle", "id", *NUMBERS, "groups_sha256", "at", "times", "pairs", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, id_type = sides_of(path_a, path_b), None
        bundle = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0
        lists = pa.list_(pa.int64())

        def rows(columns: list[list], count: int) -> pa.RecordBatch:
            types = [pa.int64(), id_type, *[pa.int64()] * len(NUMBERS), pa.string(), pa.binary(), pa.binary(), lists, lists]
            return pa.RecordBatch.from_arrays([pa.array(c if c is not None else [None] * count, t) for c, t in zip(columns, types, strict=True)], names)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal bundle, size
            distinct, docs = np.unique(np.concatenate([h[-2] for h in held]), return_counts=True)
            for low in range(0, len(held), 1024):
                part = held[low : low + 1024]
                at = [packed(np.diff(np.searchsorted(distinct, h[-2]), prepend=0)) for h in part]
                yield rows([[bundle] * len(part), *[[h[i] for h in part] for i in range(len(NUMBERS) + 2)], at, [packed(h[-1]) for h in part], None, None], len(part))
            for low in range(0, len(distinct), ROW_PAIRS):
                yield rows([[bundle], *[None] * (len(NUMBERS) + 4), [distinct[low : low + ROW_PAIRS]], [docs[low : low + ROW_PAIRS]]], 1)
            held.clear()
            bundle, size = bundle + 1, 0

        for batch in batches:
            id_type = batch.schema.field(0).type
            keys, texts, low = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            while low < len(texts):
                high, total = low, 0
                while high < len(texts) and total < GROUP_BYTES:
                    total += len(texts[high])
                    high += 1
                found = Aligned(sides, texts[low:high], shift)
                for n, key in enumerate(keys[low:high]):
                    part = slice(found.cuts[n], found.cuts[n + 1])
                    held.append((key, *[int(getattr(found, name)[n]) for name in NUMBERS], found.digests[n], found.pairs[part], found.times[part]))
                size += len(found.pairs)
                if size > BUNDLE_PAIRS:
                    yield from close()
                low = high
        if held:
            yield from close()

    bound_batches(docs.sparkSession)
    return docs.select(f"`{id_col}`", raw(text_col).alias("__bytes")).mapInArrow(run, schema)


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document (id): n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The count of an id pair is the number of documents that hold it linked; ``n_best`` are the links whose
    count is the highest of their first id, ``count_sum`` adds up the counts of all links.
    """
    path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    shift = (len(read_model(path_b).pieces) - 1).bit_length()
    table = written(_bundles(docs, id_col, text_col, path_a, path_b, shift), "aligned")
    pairs = table.where("pairs is not null").select("bundle", F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("bundle", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    known = pair_counts(pairs, shift)
    replies = pairs.select("bundle", "pair").join(known, "pair").select("bundle", "pair", "docs", "best")
    rows = table.where("pairs is null").select(F.col("bundle").alias("own"), "id", *NUMBERS, "groups_sha256", "at", "times")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, {', '.join(f'{n} long' for n in NUMBERS)}, n_best long, count_sum long, groups_sha256 string"

    def settle(own: pa.Table, reply: pa.Table) -> pa.Table:
        order = np.argsort(reply.column("pair").to_numpy())
        docs, best = reply.column("docs").to_numpy()[order], reply.column("best").to_numpy()[order]
        n_best, sums = [], []
        for at, times in zip(own.column("at").to_pylist(), own.column("times").to_pylist(), strict=True):
            place, times = np.cumsum(unpacked(at)), unpacked(times)
            n_best.append(int(times[best[place]].sum()))
            sums.append(int((times * docs[place]).sum()))
        return pa.table({"id": own.column("id"), **{n: own.column(n) for n in NUMBERS}, "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(sums, pa.int64()), "groups_sha256": own.column("groups_sha256")})

    found = rows.groupBy("own").cogroup(replies.groupBy("bundle")).applyInArrow(settle, schema)
    return found.withColumnRenamed("id", id_col)


def pair_counts(pairs: DataFrame, shift: int) -> DataFrame:
    """(pair, docs, best): documents of every pair over all bundles, and whether they are the most of its first id."""
    totals = pairs.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("first", F.shiftright("pair", shift))
    tops = totals.groupBy("first").agg(F.max("docs").alias("top"))
    return totals.join(tops, "first").select("pair", "docs", (F.col("docs") == F.col("top")).alias("best"))
