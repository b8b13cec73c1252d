"""Histogram gradient-boosted trees on bounded samples, flattened into arrays for vectorised traversal.

``fit`` bins each feature at quantiles, grows perfect binary trees of ``depth`` levels on logistic loss (a node that
finds no gain sends all its rows left) and returns arrays [trees, nodes]. ``predict`` walks all rows through all
trees level by level in numpy. Results depend on the multiset of rows only up to float rounding; callers sort
their samples. NaN counts as the least value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    base: float
    feature: np.ndarray  # [trees, 2**depth - 1] int32
    cut: np.ndarray  # [trees, 2**depth - 1] float32; greater goes right
    leaf: np.ndarray  # [trees, 2**depth] float32

    @property
    def depth(self) -> int:
        return self.leaf.shape[1].bit_length() - 1


def constant(base: float) -> Trees:
    return Trees(base, np.zeros((0, 1), np.int32), np.zeros((0, 1), np.float32), np.zeros((0, 2), np.float32))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: int = 5) -> Trees:
    """Trees for labels y in {0, 1}; with no rows, or one class only, a constant with add-one smoothing."""
    n, f = x.shape if x.ndim == 2 else (0, 0)
    p = (y.sum() + 1.0) / (n + 2.0)
    base = float(np.log(p / (1 - p)))
    if n == 0 or y.min() == y.max():
        return constant(base)
    x = np.nan_to_num(x.astype(np.float32), nan=-3e38)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower").astype(np.float32)) for j in range(f)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(f)], 1)
    score = np.full(n, base)
    nodes = 2**depth - 1
    feature, cut, leaf = np.zeros((trees, nodes), np.int32), np.full((trees, nodes), np.inf, np.float32), np.zeros((trees, nodes + 1), np.float32)
    for t in range(trees):
        prob = 1 / (1 + np.exp(-score))
        g, h = y - prob, prob * (1 - prob)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            gain, where = np.zeros(width), np.full((width, 2), -1)
            for j in range(f):
                key = at * bins + binned[:, j]
                gs, hs, cs = (np.bincount(key, w, width * bins).reshape(width, bins).cumsum(1) for w in (g, h, None))
                gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                s[(cs < least) | (ct - cs < least)] = 0
                s[:, len(cuts[j]) :] = 0
                b = s.argmax(1)
                best = s[np.arange(width), b]
                better = best > gain + 1e-9
                gain[better] = best[better]
                where[better] = np.stack([np.full(width, j), b], 1)[better]
            split = where[:, 0] >= 0
            for k in np.flatnonzero(split):
                feature[t, first + k], cut[t, first + k] = where[k, 0], cuts[where[k, 0]][where[k, 1]]
            right = split[at] & (binned[np.arange(n), np.maximum(where[at, 0], 0)] > where[at, 1])
            at = 2 * at + right
        gs, hs = np.bincount(at, g, nodes + 1), np.bincount(at, h, nodes + 1)
        leaf[t] = (rate * gs / (hs + l2)).astype(np.float32)
        score += leaf[t][at]
    return Trees(base, feature, cut, leaf)


def predict(m: Trees, x: np.ndarray) -> np.ndarray:
    """Probabilities of label 1."""
    score = np.full(len(x), m.base)
    x = np.ascontiguousarray(np.nan_to_num(x.astype(np.float32), nan=-3e38))
    flat, row = x.reshape(-1), np.arange(len(x)) * (x.shape[1] if x.ndim == 2 else 1)
    for t in range(len(m.leaf)):
        at = np.zeros(len(x), np.int64)
        for _ in range(m.depth):
            at = 2 * at + 1 + (flat[row + m.feature[t][at]] > m.cut[t][at])
        score += m.leaf[t][at - (len(m.leaf[t]) - 1)]
    return 1 / (1 + np.exp(-score))
