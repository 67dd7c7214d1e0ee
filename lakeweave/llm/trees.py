"""Histogram gradient-boosted trees for two classes, kept as flat arrays."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Forest(NamedTuple):
    """Full binary trees of one depth, side by side; node i has the children 2i+1 and 2i+2."""

    feature: np.ndarray  # trees x nodes; -1 at leaves
    cut: np.ndarray  # trees x nodes; larger values go right
    value: np.ndarray  # trees x nodes
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row; all rows step down a tree together."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                on = f[at]
                at = np.where(on < 0, at, 2 * at + 1 + (x[rows, on] > c[at]))
            total += v[at]
        return 1 / (1 + np.exp(-total))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, ridge: float = 1.0, least: int = 8) -> Forest:
    """Fits to rows x (float) and classes y (0 or 1). No rows: one half for all; one class: near that class."""
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    start = float(np.log(share / (1 - share)))
    nodes = 2 ** (depth + 1) - 1
    feature, cut, value = np.full((trees, nodes), -1, np.int64), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    if n == 0 or y.min() == y.max():
        return Forest(feature[:0], cut[:0], value[:0], start, depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    slots = bins * width
    flat = codes + np.arange(width) * bins
    margin = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            on = (at >= first) & (at < first + many)
            if not on.any():
                break
            place = ((at[on] - first)[:, None] * slots + flat[on]).ravel()
            sums = [np.bincount(place, np.repeat(v[on], width), many * slots).reshape(many, width, bins) for v in (g, h, np.ones(n))]
            left = [s.cumsum(2) for s in sums]
            whole = [s[:, :, -1:] for s in left]
            gain = left[0] ** 2 / (left[1] + ridge) + (whole[0] - left[0]) ** 2 / (whole[1] - left[1] + ridge) - whole[0] ** 2 / (whole[1] + ridge)
            gain[(left[2] < least) | (whole[2] - left[2] < least)] = -1
            best = gain.reshape(many, -1).argmax(1)
            for k in range(many):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    feature[t, first + k], cut[t, first + k] = j, edges[j][b]
            on = np.flatnonzero(on)
            f = feature[t, at[on]]
            go, split = on[f >= 0], f[f >= 0]
            at[go] = 2 * at[go] + 1 + (x[go, split] > cut[t, at[go]])
        gs, hs = np.bincount(at, g, nodes), np.bincount(at, h, nodes)
        value[t] = -rate * gs / (hs + ridge)
        margin += value[t][at]
    return Forest(feature, cut, value, start, depth)
