"""Small gradient-boosted trees on numpy, fitted on bounded samples and sent to the executors.

Trees grow level by level on binned features with logistic or softmax loss.  A fitted model is a
few arrays, so it can be broadcast and applied to Arrow batches without further dependencies.
"""

from __future__ import annotations

import numpy as np


class _Tree:
    """A complete binary tree of fixed depth on binned features."""

    __slots__ = ("depth", "feature", "threshold", "value")

    def __init__(self, depth: int):
        self.depth = depth
        self.feature = np.zeros(2**depth - 1, np.int32)
        self.threshold = np.full(2**depth - 1, 255, np.int32)  # bins up to the threshold go left
        self.value = np.zeros(2**depth, np.float64)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(self.depth):
            node = 2 * node + 1 + (bins[rows, self.feature[node]] > self.threshold[node])
        return node - (2**self.depth - 1)


class GradientBoosting:
    """Binary (one output) or multi-class (softmax) boosting; features may hold NaN."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, penalty: float = 1.0, least_weight: float = 3.0):
        self.trees, self.depth, self.rate, self.bins, self.penalty, self.least_weight = trees, depth, rate, bins, penalty, least_weight
        self.edges: list[np.ndarray] = []
        self.ensemble: list[list[_Tree]] = []
        self.classes = 2
        self.temperature = 1.0
        self.start = np.zeros(1)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.int16)
        for j, edges in enumerate(self.edges):
            column = x[:, j]
            out[:, j] = np.where(np.isnan(column), 0, 1 + np.searchsorted(edges, column, "left"))
        return out

    def _grow(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> _Tree:
        tree, width = _Tree(self.depth), self.bins + 2
        node = np.zeros(len(bins), np.int64)
        for level in range(self.depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best_gain, best_feature, best_bin = np.zeros(count), np.zeros(count, int), np.full(count, 255)
            for j in range(bins.shape[1]):
                at = local * width + bins[:, j]
                gs = np.bincount(at, g, count * width).reshape(count, width).cumsum(1)
                hs = np.bincount(at, h, count * width).reshape(count, width).cumsum(1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + self.penalty) + (gt - gl) ** 2 / (ht - hl + self.penalty) - gt**2 / (ht + self.penalty)
                gain[(hl < self.least_weight) | (ht - hl < self.least_weight)] = 0
                top = gain.argmax(1)
                value = gain[np.arange(count), top]
                better = value > best_gain + 1e-9
                best_gain[better], best_feature[better], best_bin[better] = value[better], j, top[better]
            tree.feature[first : first + count], tree.threshold[first : first + count] = best_feature, best_bin
            node = 2 * node + 1 + (bins[np.arange(len(bins)), best_feature[local]] > best_bin[local])
        leaf = node - (2**self.depth - 1)
        size = 2**self.depth
        tree.value = -self.rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + self.penalty)
        return tree

    def fit(self, x: np.ndarray, y: np.ndarray, classes: int = 2, weight: np.ndarray | None = None) -> GradientBoosting:
        x = np.asarray(x, float)
        y = np.asarray(y, int)
        weight = np.ones(len(y)) if weight is None else np.asarray(weight, float)
        self.classes, self.edges, self.ensemble = classes, [], []
        for j in range(x.shape[1]):
            column = x[~np.isnan(x[:, j]), j]
            self.edges.append(np.unique(np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(column) else np.zeros(0))
        outputs = 1 if classes == 2 else classes
        self.start = np.zeros(outputs)
        if not len(y):
            return self
        bins = self._binned(x)
        score = np.zeros((len(y), outputs))
        truth = (y[:, None] == (np.array([1]) if outputs == 1 else np.arange(classes))[None, :]).astype(float)
        for _ in range(self.trees):
            p = self._probability(score)[:, -1:] if outputs == 1 else self._probability(score)
            group = []
            for k in range(outputs):
                tree = self._grow(bins, (p[:, k] - truth[:, k]) * weight, np.maximum(p[:, k] * (1 - p[:, k]), 1e-6) * weight)
                score[:, k] += tree.value[tree.leaves(bins)]
                group.append(tree)
            self.ensemble.append(group)
        return self

    def decision(self, x: np.ndarray) -> np.ndarray:
        bins = self._binned(np.asarray(x, float))
        score = np.zeros((len(bins), len(self.start)))
        for group in self.ensemble:
            for k, tree in enumerate(group):
                score[:, k] += tree.value[tree.leaves(bins)]
        return score

    def _probability(self, score: np.ndarray) -> np.ndarray:
        if score.shape[1] == 1:
            p = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
            return np.hstack([1 - p, p])
        e = np.exp(score - score.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> GradientBoosting:
        """Temperature scaling on held-out rows."""
        if len(y):
            score, rows = self.decision(x), np.arange(len(y))
            losses = {t: -np.log(np.maximum(self._probability(score / t)[rows, y], 1e-12)).mean() for t in np.geomspace(0.4, 6, 40)}
            self.temperature = float(min(losses, key=losses.get))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities, one row for each row of ``x``."""
        if not len(x):
            return np.zeros((0, self.classes))
        return self._probability(self.decision(x) / self.temperature)
