"""Gradient-boosted trees over binned features and isotonic calibration, for samples that fit on the driver."""

from __future__ import annotations

import numpy as np


def _bins(x: np.ndarray, most: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, most + 1)[1:-1])) for c in x.T]


class BoostedTrees:
    """Logistic loss, second-order splits, trees of one depth stored as arrays."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: int = 20, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.base, self.edges, self.made = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.edges = float(np.log(p / (1 - p))), _bins(x, self.bins)
        b = self._binned(x)
        n, f, width = len(y), x.shape[1], self.bins + 1
        slots = b + np.arange(f) * width
        out = np.full(n, self.base)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-out))
            g, h = q - y, q * (1 - q)
            node, tree = np.zeros(n, np.int64), []
            for level in range(self.depth):
                size = 1 << level
                flat = (node[:, None] * (f * width) + slots).ravel()
                sums = [np.bincount(flat, np.repeat(v, f), size * f * width).reshape(size, f, width).cumsum(2) for v in (g, h, np.ones(n))]
                left, all_ = [s[:, :, :-1] for s in sums], [s[:, :1, -1:] for s in sums]
                right = [a - s for a, s in zip(all_, left, strict=True)]
                gain = sum(s[0] ** 2 / (s[1] + self.ridge) for s in (left, right)) - all_[0] ** 2 / (all_[1] + self.ridge)
                gain[(left[2] < self.least) | (right[2] < self.least)] = 0
                best = gain.reshape(size, -1).argmax(1)
                feature, cut = best // (width - 1), best % (width - 1)
                cut[gain.reshape(size, -1).max(1) <= 1e-9] = width  # all go left
                tree.append((feature, cut))
                node = 2 * node + (b[np.arange(n), feature[node]] > cut[node])
            size = 1 << self.depth
            leaf = -self.rate * np.bincount(node, g, size) / (np.bincount(node, h, size) + self.ridge)
            self.made.append((tree, leaf))
            out += leaf[node]
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)])

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, rows = self._binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for tree, leaf in self.made:
            node = np.zeros(len(x), np.int64)
            for feature, cut in tree:
                node = 2 * node + (b[rows, feature[node]] > cut[node])
            out += leaf[node]
        return out


class Isotonic:
    """The non-decreasing fit of least squares, by pooling neighbours that disagree; linear between the pools."""

    def fit(self, s: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(s, kind="stable")
        pools: list[list[float]] = []  # sum of y, count, least s, greatest s
        for v, t in zip(s[order], y[order], strict=True):
            if pools and v == pools[-1][3]:
                pools[-1][0] += t
                pools[-1][1] += 1
            else:
                pools.append([float(t), 1.0, v, v])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                a = pools.pop()
                pools[-1] = [pools[-1][0] + a[0], pools[-1][1] + a[1], pools[-1][2], a[3]]
        self.at = np.array([x for p in pools for x in (p[2], p[3])])
        self.level = np.array([p[0] / p[1] for p in pools for _ in range(2)])
        return self

    def __call__(self, s: np.ndarray) -> np.ndarray:
        return np.interp(s, self.at, self.level)
