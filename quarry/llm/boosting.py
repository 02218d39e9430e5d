"""Gradient-boosted oblivious trees for binary labels, in numpy.

Every level of a tree tests one feature against one threshold, so scoring a batch is a
few vector comparisons per tree.  Training works on quantile bins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Booster:
    trees: int = 45
    depth: int = 5
    rate: float = 0.3
    bins: int = 32
    l2: float = 3.0
    base: float = 0.0
    model: list = field(default_factory=list)  # (features, thresholds, leaf values)

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> "Booster":
        """``x``: rows by features, ``y``: 0/1.  A single class gives the constant model."""
        n, m = x.shape
        w = np.ones(n) if w is None else w
        p = float(np.clip(np.average(y, weights=w), 1e-4, 1 - 1e-4)) if n else 0.5
        self.base, self.model = float(np.log(p / (1 - p))), []
        if n == 0 or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        binned = [np.searchsorted(e, x[:, j], side="left").astype(np.int64) for j, e in enumerate(edges)]
        score = np.full(n, self.base)
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-score))
            g, h = w * (y - prob), w * prob * (1 - prob)
            leaf, feats, cuts = np.zeros(n, dtype=np.int64), [], []
            for level in range(self.depth):
                best = (0.0, -1, -1)
                leaves = 1 << level
                for j in range(m):
                    k = len(edges[j]) + 1
                    if k < 2:
                        continue
                    at = leaf * k + binned[j]
                    gs = np.bincount(at, g, leaves * k).reshape(leaves, k).cumsum(1)
                    hs = np.bincount(at, h, leaves * k).reshape(leaves, k).cumsum(1)
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = (gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)).sum(0)
                    b = int(gain.argmax())
                    if gain[b] > best[0] + 1e-9:
                        best = (float(gain[b]), j, b)
                if best[1] < 0:
                    break
                _, j, b = best
                leaf = leaf * 2 + (binned[j] > b)
                feats.append(j)
                cuts.append(float(edges[j][b]))
            if not feats:
                break
            k = 1 << len(feats)
            value = self.rate * np.bincount(leaf, g, k) / (np.bincount(leaf, h, k) + self.l2)
            self.model.append((feats, cuts, value))
            score += value[leaf]
        return self

    def decision(self, columns: list[np.ndarray], n: int) -> np.ndarray:
        """Log-odds of ``n`` rows whose features come as columns."""
        out = np.full(n, self.base, dtype=np.float32)
        for feats, cuts, value in self.model:
            leaf = np.zeros(n, dtype=np.uint8 if len(feats) <= 8 else np.int32)
            for j, c in zip(feats, cuts):
                leaf <<= 1
                leaf |= columns[j] > c
            out += value.astype(np.float32)[leaf]
        return out
