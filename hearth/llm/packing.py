"""Packing documents into sequences by minimum bin slack.

Every input split packs its own documents, so no text or id is shuffled. Whole
windows are cut off long documents; what remains of each goes into a pool of
lengths. For each window the longest remainder is set, and a subset-sum dynamic
programme over bitsets finds the multiset of other remainders that comes closest
to the capacity; counts are read back from the bitset of every step. Where even
the best multiset leaves a gap, one more remainder is cut to fill it. What is
left at the end of a split, less than a window, is cut at powers of two, where
a sequence needs no padding.

Ids are those of the tokenizers library with its defaults, so the string of a
special token in a text is that token. A null or empty text is the end token alone. Repeated rows are packed like any
others. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from hearth.llm.byte_bpe import byte_bpe_of
from hearth.llm.common import bound_batches

CAPACITY = 2048
END_ID = 1
POOL = 2048
OUT_IDS = 1 << 20

Piece = tuple[int, int]  # document, start; the length is the key it is stored under


def best_fill(counts: list[tuple[int, int]], target: int) -> tuple[int, list[tuple[int, int]]]:
    """Largest sum up to ``target`` of (length, count) items, and how many of each length make it."""
    mask = (1 << (target + 1)) - 1
    reach, steps = 1, []
    for length, count in counts:
        if length > target:
            continue
        before, left, part = reach, count, 1
        while left and part * length <= target:
            part = min(part, left)
            reach |= (reach << (part * length)) & mask
            left -= part
            part *= 2
        steps.append((length, count, before))
        if reach >> target & 1:
            break
    total = best = reach.bit_length() - 1
    chosen = []
    for length, count, before in reversed(steps):
        used = 0
        while not before >> total & 1:
            total -= length
            used += 1
        if used:
            chosen.append((length, used))
    return best, chosen


class Packer:
    """Windows of one split; yields lists of (document, start, length) per sequence."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.pool: dict[int, list[Piece]] = defaultdict(list)
        self.size = self.held = 0

    def add(self, document: int, start: int, length: int) -> None:
        self.pool[length].append((document, start))
        self.size += 1
        self.held += length

    def take(self, length: int) -> tuple[int, int, int]:
        document, start = self.pool[length].pop()
        if not self.pool[length]:
            del self.pool[length]
        self.size -= 1
        self.held -= length
        return document, start, length

    def cut(self, length: int) -> tuple[int, int, int]:
        """A piece of the longest remainder, or all of it if it is not longer."""
        document, start, whole = self.take(max(self.pool))
        if whole > length:
            self.add(document, start + length, whole - length)
        return document, start, min(length, whole)

    def window(self) -> list[tuple[int, int, int]]:
        first = self.take(max(self.pool))
        rest = self.capacity - first[2]
        counts = [(n, len(self.pool[n])) for n in sorted(self.pool, reverse=True)]
        best, chosen = best_fill(counts, rest)
        found = [first, *(self.take(n) for n, used in chosen for _ in range(used))]
        rest -= best
        while rest:
            found.append(self.cut(rest))
            rest -= found[-1][2]
        return found

    def windows(self, keep: int) -> Iterator[list[tuple[int, int, int]]]:
        while self.size > keep and self.held >= self.capacity:
            yield self.window()

    def tail(self) -> Iterator[list[tuple[int, int, int]]]:
        """What is less than a window, in sequences as long as a power of two."""
        while self.held:
            rest, found = 1 << (self.held.bit_length() - 1), []
            while rest:
                found.append(self.cut(rest))
                rest -= found[-1][2]
            yield found


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, start, length, doc_tokens, sequence_id, offset, ids.

    ids holds the piece's token ids as little-endian unsigned 32-bit numbers.
    """
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    names = [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = byte_bpe_of(path), Packer(capacity)
        held: dict[int, list] = {}
        number = next_id = 0
        base = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        waiting = 0

        def emit(pieces: list[tuple[int, int, int]]) -> None:
            nonlocal next_id, waiting
            offset = 0
            for document, start, length in pieces:
                key, ids, left = held[document]
                out.append((key, start, length, len(ids), base + next_id, offset, ids[start : start + length].tobytes()))
                offset += length
                if left == length:
                    del held[document]
                else:
                    held[document][2] = left - length
            next_id += 1
            waiting += offset

        def flush() -> pa.RecordBatch:
            nonlocal waiting
            columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate([id_type, *[pa.int64()] * 5, pa.binary()])]
            out.clear()
            waiting = 0
            return pa.RecordBatch.from_arrays(columns, names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(tokenizer.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                held[number] = [key, ids, len(ids)]
                whole = len(ids) // capacity * capacity
                for start in range(0, whole, capacity):
                    emit([(number, start, capacity)])
                if whole < len(ids):
                    packer.add(number, whole, len(ids) - whole)
                number += 1
                for pieces in packer.windows(POOL) if packer.size > 2 * POOL else ():
                    emit(pieces)
                    if waiting > OUT_IDS:
                        yield flush()
                if waiting > OUT_IDS:
                    yield flush()
        for pieces in (p for part in (packer.windows(0), packer.tail()) for p in part):
            emit(pieces)
            if waiting > OUT_IDS:
                yield flush()
        if out:
            yield flush()

    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, schema)
