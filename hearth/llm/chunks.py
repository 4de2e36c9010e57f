"""Encoding texts piece by piece, each distinct piece once.

Where a tokenizer never merges across some places of a text, the ids of the text
are the ids of its pieces in order, and a piece that was met before costs one
look-up. The memory held is bounded: the store is emptied when it is full.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable

import numpy as np

STORE = 400_000


class _Pieces(dict):
    def __init__(self, owner: "ChunkStore"):
        super().__init__()
        self.owner = owner

    def __missing__(self, piece: str) -> int:
        self[piece] = place = self.owner.register(piece)
        return place


class ChunkStore:
    """Ids of the distinct pieces met so far; ``encode`` turns a list of pieces into lists of ids."""

    def __init__(self, encode: Callable[[list[str | None]], Iterable[list[int]]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.first, self.rest = _Pieces(self), {}
        self.pending: list[str | None] = []
        self.ids, self.ends = array("I"), array("q", [0])

    def register(self, piece: str | None) -> int:
        self.pending.append(piece)
        return len(self.ends) - 2 + len(self.pending)

    def settle(self) -> None:
        """Encode the pieces met since the last call."""
        done, self.pending = self.pending, []
        for ids in self.encode(done) if done else []:
            self.ids.extend(ids)
            self.ends.append(len(self.ids))

    def gather(self, places: np.ndarray) -> np.ndarray:
        ends = np.frombuffer(self.ends, np.int64)
        starts, sizes = ends[places], ends[places + 1] - ends[places]
        total = int(sizes.sum())
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
        return np.frombuffer(self.ids, np.uint32)[at] if total else np.zeros(0, np.uint32)

    def full(self) -> bool:
        return len(self.ends) > STORE
