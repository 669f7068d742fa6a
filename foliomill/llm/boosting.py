"""A small gradient-boosted tree classifier in numpy: logistic loss, binned features, trees of fixed depth."""

from __future__ import annotations

import numpy as np

#: Margins beyond this say no more in calibration.
CLIP = 6.0


class Boosted:
    """Fitted on the driver on a bounded sample; the trees are a few kilobytes and go to the workers with the function."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base, self.slope, self.shift = 0.0, 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, f = x.shape
        rank = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], rank)) for j in range(f)]
        b = np.stack([np.searchsorted(self.edges[j], x[:, j], "right") for j in range(f)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            g, h = q - y, np.maximum(q * (1 - q), 1e-6)
            feature = np.zeros(2**self.depth - 1, np.int64)
            cut = np.full(2**self.depth - 1, np.inf)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                at = node - first
                best = np.full(width, 1e-9)
                for j in range(f):
                    m = len(self.edges[j]) + 1
                    if m == 1:
                        continue
                    key = at * m + b[:, j]
                    gs = np.bincount(key, g, width * m).reshape(width, m).cumsum(1)
                    hs = np.bincount(key, h, width * m).reshape(width, m).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    k = gain[:, :-1].argmax(1)
                    top = gain[np.arange(width), k]
                    better = top > best
                    best[better] = top[better]
                    feature[first : first + width][better] = j
                    cut[first : first + width][better] = self.edges[j][k[better]]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] >= cut[node])
            leaf = node - (2**self.depth - 1)
            gl, hl = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
            value = -self.rate * gl / (hl + self.l2)
            self.trees.append((feature, cut, value))
            score += value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] >= cut[node])
            score += value[node - (2**self.depth - 1)]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 400) -> Boosted:
        """Platt scaling on held-out rows: smoothed targets, margins within ±CLIP, a prior that keeps the slope near 1."""
        m = np.clip(self.margin(x), -CLIP, CLIP)
        up, down = y.sum(), len(y) - y.sum()
        t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
        slope, shift = 1.0, 0.0
        for _ in range(steps):
            r = 1 / (1 + np.exp(-(slope * m + shift))) - t
            slope -= 0.02 * ((r * m).mean() + 0.5 * (slope - 1))
            shift -= 0.1 * (r.mean() + 0.05 * shift)
        self.slope, self.shift = float(max(slope, 0.1)), float(shift)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * np.clip(self.margin(x), -CLIP, CLIP) + self.shift)))
