"""Gradient-boosted trees for two classes in NumPy: log loss, histograms of quantile bins, trees of fixed depth."""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, width = x.shape
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)], 1)  # bin b: cuts[b - 1] < value <= cuts[b]
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        raw, offset = np.full(n, self.start), np.arange(width) * self.bins
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            feature, limit = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                key = ((node - first)[:, None] * width * self.bins + offset + binned).ravel()
                shape = (count, width, self.bins)
                gs = np.bincount(key, np.repeat(g, width), count * width * self.bins).reshape(shape).cumsum(2)
                hs = np.bincount(key, np.repeat(h, width), count * width * self.bins).reshape(shape).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hs < self.least * 0.1) | (ht - hs < self.least * 0.1)] = -1
                flat = gain.reshape(count, -1)
                best = flat.argmax(1)
                for i in range(count):
                    f, b = divmod(int(best[i]), self.bins)
                    if flat[i, best[i]] > 1e-6 and b < len(cuts[f]):
                        feature[first + i], limit[first + i] = f, cuts[f][b]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > limit[node])
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.ridge)
            self.trees.append((feature, limit, value))
            raw += value[leaf]
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, limit, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += value[node - (2**self.depth - 1)]
        return out
