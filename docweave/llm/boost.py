"""Gradient-boosted trees for two classes, in numpy; small data, fixed seed."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """A complete binary tree: inner nodes have a feature and a cut, leaves a value."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            right = x[np.arange(len(x)), self.feature[node]] > self.cut[node]
            node = 2 * node + 1 + right
        return self.value[node - (1 << self.depth) + 1]


@dataclass
class BoostedTrees:
    """Logistic loss, second-order leaves, exact cuts at value midpoints (at most ``cuts`` a feature)."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    ridge: float = 1.0
    cuts: int = 24
    trees: list[Tree] = field(default_factory=list)
    bias: float = 0.0
    #: slope and offset of the calibration p = sigmoid(slope * margin + offset)
    slope: float = 1.0
    offset: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(p / (1 - p)))
        grid = []
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            mids = (values[1:] + values[:-1]) / 2
            grid.append(mids if len(mids) <= self.cuts else np.quantile(mids, np.linspace(0, 1, self.cuts)))
        margin = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-margin))
            tree = self._grow(x, prob - y, prob * (1 - prob), grid)
            self.trees.append(tree)
            margin += self.rate * tree.predict(x)
        return self

    def _grow(self, x, grad, hess, grid) -> Tree:
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        members = {0: np.arange(len(x))}
        for node in range(inner):
            rows = members.pop(node)
            g, h = grad[rows], hess[rows]
            best = (1e-9, 0, np.inf)
            whole = g.sum() ** 2 / (h.sum() + self.ridge)
            for j, cuts in enumerate(grid):
                if len(cuts) and len(rows) > 1:
                    at = np.searchsorted(cuts, x[rows, j], side="left")  # x > cuts[k] for k < at
                    gl = np.cumsum(np.bincount(at, g, len(cuts) + 1))[:-1]
                    hl = np.cumsum(np.bincount(at, h, len(cuts) + 1))[:-1]
                    gain = gl**2 / (hl + self.ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + self.ridge) - whole
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, cuts[k])
            feature[node], cut[node] = best[1], best[2]
            right = x[rows, best[1]] > best[2]
            members[2 * node + 1], members[2 * node + 2] = rows[~right], rows[right]
        leaves = [members[inner + k] for k in range(inner + 1)]
        value = np.array([-grad[r].sum() / (hess[r].sum() + self.ridge) for r in leaves])
        return Tree(feature, cut, value, self.depth)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> BoostedTrees:
        """Fit slope and offset on rows that the trees have not seen (Newton steps, smoothed targets)."""
        m = self.margin(x)
        pos, neg = y.sum(), len(y) - y.sum()
        t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(a * m + b)))
            w = np.maximum(p * (1 - p), 1e-6)
            g = np.array([((p - t) * m).sum(), (p - t).sum()])
            hess = np.array([[(w * m * m).sum() + 1e-6, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-6]])
            da, db = np.linalg.solve(hess, g)
            a, b = a - 0.5 * da, b - 0.5 * db
        self.slope, self.offset = float(a), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.offset)))
