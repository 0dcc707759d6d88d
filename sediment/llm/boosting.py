"""Gradient-boosted trees on small feature tables, in numpy: logistic loss, binned features, Newton leaves,
and a Platt scaling fitted on rows the trees haven't seen."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def node(self) -> int:
        for column, x in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            column.append(x)
        return len(self.feature) - 1

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature, cut, left, right = map(np.asarray, (self.feature, self.cut, self.left, self.right))
        while (inner := feature[at] >= 0).any():
            k = np.flatnonzero(inner)
            n = at[k]
            at[k] = np.where(x[k, feature[n]] <= cut[n], left[n], right[n])
        return np.asarray(self.value)[at]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Boosted:
    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, l2: float = 1.0, bins: int = 32):
        self.rounds, self.depth, self.rate, self.l2, self.bins = rounds, depth, rate, l2, bins
        self.trees: list[Tree] = []
        self.bias, self.slope, self.shift = 0.0, 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, xc: np.ndarray, yc: np.ndarray) -> Boosted:
        """Trees from (x, y), calibration from (xc, yc)."""
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for c in x.T]
        code = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
        mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.bias = float(np.log(mean / (1 - mean)))
        z = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            p = _sigmoid(z)
            tree = Tree()
            self._grow(tree, code, cuts, y - p, np.maximum(p * (1 - p), 1e-9), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            z = z + tree(x)
        z = self._raw(xc)
        for _ in range(200):  # Platt: Newton steps on slope and shift
            p = _sigmoid(self.slope * z + self.shift)
            w = np.maximum(p * (1 - p), 1e-6)
            g = np.array([((p - yc) * z).sum() + 1e-3 * (self.slope - 1), (p - yc).sum() + 1e-3 * self.shift])
            h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(h, g)
            self.slope, self.shift = self.slope - step[0], self.shift - step[1]
            if np.abs(step).max() < 1e-8:
                break
        return self

    def _grow(self, tree: Tree, code: np.ndarray, cuts: list, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> int:
        me = tree.node()
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, 0)
        if depth and len(rows) >= 8:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                gl = np.cumsum(np.bincount(code[rows, f], g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(code[rows, f], h[rows], len(c) + 1))[:-1]
                gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
        _, f, k = best
        if f < 0:
            tree.value[me] = float(self.rate * gs / (hs + self.l2))
            return me
        go = code[rows, f] <= k
        tree.feature[me], tree.cut[me] = f, float(cuts[f][k])
        tree.left[me] = self._grow(tree, code, cuts, g, h, rows[go], depth - 1)
        tree.right[me] = self._grow(tree, code, cuts, g, h, rows[~go], depth - 1)
        return me

    def _raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for tree in self.trees:
            z += tree(x)
        return z

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return _sigmoid(self.slope * self._raw(x) + self.shift) if len(x) else np.empty(0)
