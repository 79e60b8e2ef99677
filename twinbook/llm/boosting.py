"""Gradient-boosted trees for a few classes in NumPy: fitted on the driver from a bounded sample, applied in Arrow batches."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Softmax boosting with histogram splits; all trees of a round have ``depth`` levels."""

    def __init__(self, classes: list[str], rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, l2: float = 1.0):
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.l2 = classes, rounds, depth, rate, bins, l2
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.temperature = 1.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> BoostedTrees:
        n, f = x.shape
        k = len(self.classes)
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        b = self._binned(x)
        hot = np.eye(k)[y]
        raw = np.zeros((n, k))
        cells = self.bins + 1
        columns = np.arange(f)[None, :] * cells + b
        for _ in range(self.rounds):
            e = np.exp(raw - raw.max(1, keepdims=True))
            p = e / e.sum(1, keepdims=True)
            for c in range(k):
                g, h = (p[:, c] - hot[:, c]) * weight, np.maximum(p[:, c] * (1 - p[:, c]), 1e-6) * weight
                feature, cut = np.full(2**self.depth, -1), np.zeros(2**self.depth, np.int64)
                node = np.ones(n, np.int64)
                for level in range(self.depth):
                    wide = 2**level
                    at = ((node - wide)[:, None] * (f * cells) + columns).ravel()
                    gs = np.bincount(at, np.repeat(g, f), wide * f * cells).reshape(wide, f, cells).cumsum(2)
                    hs = np.bincount(at, np.repeat(h, f), wide * f * cells).reshape(wide, f, cells).cumsum(2)
                    gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    best = gain.reshape(wide, -1).argmax(1)
                    feature[wide : 2 * wide], cut[wide : 2 * wide] = np.divmod(best, cells)
                    node = node * 2 + (b[np.arange(n), feature[node]] > cut[node])
                leaf = node - 2**self.depth
                value = -self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.l2)
                raw[:, c] += value[leaf]
                self.trees.append((feature, cut, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, k = self._binned(x), len(self.classes)
        out = np.zeros((len(x), k))
        rows = np.arange(len(x))
        for i, (feature, cut, value) in enumerate(self.trees):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                node = node * 2 + (b[rows, feature[node]] > cut[node])
            out[:, i % k] += value[node - 2**self.depth]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x) / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Sets the temperature that makes labelled rows most likely, on a grid; labels are smoothed by 1 / (rows + 2), so that a
        faultless holdout doesn't ask for certainty."""
        z, k = self.raw(x), len(self.classes)
        eps = 1 / (len(y) + 2)
        wanted = np.full(z.shape, eps / (k - 1))
        wanted[np.arange(len(y)), y] = 1 - eps

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(1, keepdims=True)
            return float(-(wanted * (s - np.log(np.exp(s).sum(1, keepdims=True)))).sum(1).mean())

        grid = np.geomspace(0.25, 8, 41)
        self.temperature = float(grid[np.argmin([loss(t) for t in grid])])
        return self
