"""Isolation forests of many sources at once in NumPy; used inside Arrow batches.

A tree cuts the box of all possible values, not the range of its sample: a cut far from the ordinary points is as likely as
one among them, so that what lies beyond them is parted from them early, by how far it lies beyond and not by whether the
sample happens to hold its like. All randomness is a hash of source, tree and node, so that a forest is the same wherever
and beside whichever others it is grown.
"""

from __future__ import annotations

import numpy as np


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 63-bit hash of integers (splitmix64)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def _uniform(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x, seed) / 2.0**63


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 2)
    return np.where(n > 1, 2 * (np.log(np.maximum(safe - 1, 1)) + 0.5772156649) - 2 * (safe - 1) / safe, 0.0)


class Forests:
    """``trees`` trees for each source over ``psi`` of its points; ``points``: one array (rows, features) a source, none empty.

    A source that has fewer is filled up with copies of the half of its points that lie nearest to their middle, each moved at
    random by up to ``jitter`` of the box, so that the ordinary ones of few points are as dense a crowd as those of many. ``domain``: the upper end of the box of each feature, which
    begins at 0; larger values count as that end.
    """

    def __init__(self, points: list[np.ndarray], seeds: list[int], domain: np.ndarray, trees: int = 30, psi: int = 64, depth: int = 12, jitter: float = 0.03):
        self.trees, self.depth, self.domain = trees, depth, np.asarray(domain, float)
        f, roots = len(self.domain), len(points) * trees
        taken = []
        tree_seed = mix(np.repeat(np.asarray(seeds, np.int64), trees) * 1_000_003 + np.tile(np.arange(trees), len(points)), 11)
        for s, p in enumerate(points):
            n = len(p)
            key = mix(tree_seed[s * trees : (s + 1) * trees, None] + np.arange(max(n, psi))[None, :], 12)
            if n >= psi:
                x = p[np.argpartition(key, psi - 1, axis=1)[:, :psi]]
            else:
                inner = p[np.argsort((np.abs(p - np.median(p, axis=0)) / self.domain).sum(1), kind="stable")[: (n + 1) // 2]]
                move = (_uniform(key[:, n:, None] + np.arange(f), 13) - 0.5) * 2 * jitter * self.domain
                x = np.concatenate([np.broadcast_to(p, (trees, n, f)), inner[key[:, n:] % len(inner)] + move], axis=1)
            taken.append(np.clip(x, 0, self.domain).reshape(-1, f).astype(np.float32))
        x = np.concatenate(taken)
        node = np.repeat(np.arange(roots), psi)
        code, seed = np.ones(roots, np.int64), tree_seed
        low, high = np.zeros((roots, f)), np.broadcast_to(self.domain, (roots, f)).copy()
        count = np.bincount(node, minlength=roots)
        features, cuts, children, counts = [], [], [], []
        begin, made = 0, roots
        for level in range(depth + 1):
            feature, cut, child = np.full(len(count), -1, np.int8), np.zeros(len(count), np.float32), np.zeros(len(count), np.int32)
            split = np.flatnonzero(count >= 2) if level < depth else np.zeros(0, np.int64)
            features.append(feature), cuts.append(cut), children.append(child), counts.append(count)
            if not len(split):
                break
            draw = seed[split] + code[split]
            chosen = mix(draw, 14) % f
            at = low[split, chosen] + _uniform(draw, 15) * (high[split, chosen] - low[split, chosen])
            feature[split], cut[split], child[split] = chosen, at, made + 2 * np.arange(len(split))
            live = count[node - begin] >= 2
            node, x = node[live] - begin, x[live]
            node = child.take(node) + (x.ravel().take(np.arange(len(x)) * f + feature.take(node)) > cut.take(node))
            begin, made = made, made + 2 * len(split)
            count = np.bincount(node - begin, minlength=2 * len(split))
            low, high = np.repeat(low[split], 2, 0), np.repeat(high[split], 2, 0)
            pair = np.arange(len(split)) * 2
            high[pair, chosen] = at
            low[pair + 1, chosen] = at
            code, seed = np.repeat(code[split] * 2, 2), np.repeat(seed[split], 2)
            code[1::2] += 1
        self.feature, self.cut, self.child = np.concatenate(features), np.concatenate(cuts), np.concatenate(children)
        self.rest = average_path(np.concatenate(counts)).astype(np.float32)

    def score(self, points: np.ndarray, source: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1) of each row in the forest of its source: near 1 parted at once, below 0.5 ordinary."""
        n = len(points)
        points = np.minimum(points, self.domain).astype(np.float32)
        node = (source[:, None] * self.trees + np.arange(self.trees)[None, :]).astype(np.int32).ravel()
        flat, wide = points.ravel(), len(self.domain)
        row = np.repeat(np.arange(n, dtype=np.int64) * wide, self.trees)
        length = np.zeros(n * self.trees, np.float32)
        where = np.arange(n * self.trees, dtype=np.int32)
        for _ in range(self.depth):
            feature = self.feature.take(node)
            live = feature >= 0
            if not live.all():
                length[where[~live]] += self.rest[node[~live]]
                where, node, row, feature = where[live], node[live], row[live], feature[live]
            if not len(where):
                break
            length[where] += 1
            node = self.child.take(node) + (flat.take(row + feature) > self.cut.take(node))
        length[where] += self.rest[node]
        return 2.0 ** (-length.reshape(n, self.trees).mean(1) / (0.75 * self.depth))
