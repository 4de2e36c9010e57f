"""Gradient-boosted regression trees for two classes, in numpy: histograms, log loss, depth-wise growth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Trees as arrays in heap order: feature (-1: leaf), limit, and leaf values as log odds."""

    base: float
    features: np.ndarray
    limits: np.ndarray
    values: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, value in zip(self.features, self.limits, self.values, strict=True):
            at = np.zeros(len(x), np.int64)
            while True:
                split = feature[at]
                inner = split >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(split, 0)] > limit[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            out += value[at]
        return out


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Newton boosting of the log loss; without both classes only the base remains."""
    share = float(np.clip((weight @ y) / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    size = 2 ** (depth + 1) - 1
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])] if len(y) else []
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1) if len(y) else None
    score = np.full(len(y), base)
    for _ in range(trees if len(y) and 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        slope, curve = weight * (y - p), weight * p * (1 - p)
        feature, limit, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(len(y), np.int64)
        for own in range(size):
            rows = np.flatnonzero(node == own)
            if not len(rows):
                continue
            g, h = slope[rows].sum(), curve[rows].sum()
            value[own] = rate * g / (h + ridge)
            if 2 * own + 2 >= size:
                continue
            best = (1e-6, -1, 0)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                left_g = np.cumsum(np.bincount(binned[rows, j], slope[rows], len(c) + 1))[:-1]
                left_h = np.cumsum(np.bincount(binned[rows, j], curve[rows], len(c) + 1))[:-1]
                gain = left_g**2 / (left_h + ridge) + (g - left_g) ** 2 / (h - left_h + ridge) - g**2 / (h + ridge)
                gain[(left_h < 1e-3) | (h - left_h < 1e-3)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
            if best[1] >= 0:
                _, feature[own], k = best
                limit[own] = cuts[feature[own]][k]
                node[rows] = 2 * own + 1 + (binned[rows, feature[own]] > k)
        score += value[node]
        found.append((feature, limit, value))
    empty = np.zeros((0, size))
    arrays = [np.stack(a) for a in zip(*found, strict=True)] if found else [empty.astype(np.int64), empty, empty]
    return Boosted(base, *arrays)
