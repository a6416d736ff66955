"""Gradient-boosted trees for binary labels: logistic loss, histogram splits, Newton leaves. Trained on bounded samples."""

from __future__ import annotations

import numpy as np


class Boosted:
    """trees: list of (feature, threshold, left, right, value) arrays; predict gives probabilities."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: int = 5, l2: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least, self.l2 = trees, depth, rate, bins, least, l2
        self.nodes: list[list[tuple]] = []
        self.flat: list[tuple] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> "Boosted":
        x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
        w = np.ones(len(y)) if weight is None else np.asarray(weight, np.float64)
        p = np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        cuts = [np.unique(np.concatenate([c, (np.unique(x[:, f])[:-1] + np.unique(x[:, f])[1:]) / 2])) if len(np.unique(x[:, f])) <= self.bins else c for f, c in enumerate(cuts)]
        binned = np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-score))
            g, h = w * (y - q), w * q * (1 - q)
            tree: list[tuple] = []
            leaf = np.zeros(len(y))
            self._grow(tree, np.arange(len(y)), binned, cuts, g, h, 0, leaf)
            score += self.rate * leaf
            self.nodes.append(tree)
        self.flat = [tuple(np.array(c) for c in zip(*tree)) for tree in self.nodes]
        return self

    def _grow(self, tree, rows, binned, cuts, g, h, depth, leaf) -> int:
        me = len(tree)
        gs, hs = g[rows].sum(), h[rows].sum()
        value = gs / (hs + self.l2)
        tree.append((-1, 0.0, -1, -1, value))
        if depth < self.depth and len(rows) >= 2 * self.least:
            best = (1e-6, -1, -1)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, f]
                gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                gain[(nl < self.least) | (len(rows) - nl < self.least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
            if best[1] >= 0:
                _, f, k = best
                left = binned[rows, f] <= k
                a = self._grow(tree, rows[left], binned, cuts, g, h, depth + 1, leaf)
                b = self._grow(tree, rows[~left], binned, cuts, g, h, depth + 1, leaf)
                tree[me] = (f, float(cuts[f][k]), a, b, value)
                return me
        leaf[rows] = value
        return me

    def predict(self, x) -> np.ndarray:
        x = np.asarray(x, np.float64)
        if not len(x):
            return np.zeros(0)
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, left, right, value in self.flat:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[at]
                if (f < 0).all():
                    break
                at = np.where(f < 0, at, np.where(x[rows, np.maximum(f, 0)] < cut[at], left[at], right[at]))
            score += self.rate * value[at]
        return 1 / (1 + np.exp(-score))
