"""Gradient-boosted trees for two classes on binned features, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of one depth, each a heap of (feature, threshold), over leaf values."""

    def __init__(self, features, thresholds, leaves, start: float, depth: int):
        self.features, self.thresholds, self.leaves, self.start, self.depth = features, thresholds, leaves, start, depth

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 32, least: float = 2.0, smooth: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss; thresholds are at quantiles of each feature."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    rate_of = min(0.99, max(0.01, float(y.mean())))
    start = float(np.log(rate_of / (1 - rate_of)))
    score = np.full(n, start)
    inner = 2**depth - 1
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            best = (1e-6, 0, np.inf)
            if len(mine):
                total_g, total_h = g[mine].sum(), h[mine].sum()
                for j in range(width):
                    k = len(edges[j])
                    if not k:
                        continue
                    gs = np.cumsum(np.bincount(binned[mine, j], g[mine], k + 1))[:-1]
                    hs = np.cumsum(np.bincount(binned[mine, j], h[mine], k + 1))[:-1]
                    gain = gs**2 / (hs + smooth) + (total_g - gs) ** 2 / (total_h - hs + smooth) - total_g**2 / (total_h + smooth)
                    gain[(hs < least) | (total_h - hs < least)] = 0
                    b = int(np.argmax(gain))
                    if gain[b] > best[0]:
                        best = (float(gain[b]), j, float(edges[j][b]))
            f[node], t[node] = best[1], best[2]
            at[mine] = 2 * node + 1 + (x[mine, f[node]] > t[node])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + smooth)
        score += value[leaf]
        features.append(f)
        thresholds.append(t)
        leaves.append(value)
    return Boosted(features, thresholds, leaves, start, depth)


def calibrated(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least threshold above which held-out rows have this precision."""
    order = np.argsort(-scores, kind="stable")
    good = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    fine = np.flatnonzero(good >= precision)
    return float(scores[order][fine[-1]]) if len(fine) else np.inf
