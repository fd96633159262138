"""Small models that several operators fit on the driver or in one task."""

from __future__ import annotations

import numpy as np


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the intercept last) of a ridge logistic regression by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.diag([penalty] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def probability(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    mean, scale, w = model
    return 1 / (1 + np.exp(-np.clip((x - mean) / scale @ w[:-1] + w[-1], -30, 30)))


class Forest:
    """A random forest for two classes: bootstrap samples, a few features tried at each split, Gini impurity. Each
    leaf holds the share of class 1; the forest gives the mean."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        self.trees = trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, n_trees: int = 40, depth: int = 10, leaf: int = 2, seed: int = 7) -> Forest:
        r = np.random.default_rng(seed)
        return cls([_tree(x[s], y[s], depth, leaf, r) for s in (r.integers(0, len(x), len(x)) for _ in range(n_trees))])

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), int)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                low = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += share[at]
        return total / max(1, len(self.trees))


def _tree(x: np.ndarray, y: np.ndarray, depth: int, leaf: int, r: np.random.Generator) -> tuple[np.ndarray, ...]:
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
        if level == depth or len(rows) < 2 * leaf or y[rows].min() == y[rows].max():
            return me
        best = (np.inf, -1, 0.0)
        for f in r.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, ones = x[rows[order], f], np.cumsum(y[rows[order]])
            n = np.arange(1, len(rows))
            a, b = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(rows) - n)
            impurity = n * a * (1 - a) + (len(rows) - n) * b * (1 - b)
            impurity[(v[1:] == v[:-1]) | (n < leaf) | (len(rows) - n < leaf)] = np.inf
            k = int(impurity.argmin())
            if impurity[k] < best[0]:
                best = (impurity[k], int(f), (v[k] + v[k + 1]) / 2)
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            nodes[me][:2] = best[1:]
            nodes[me][2], nodes[me][3] = grow(rows[low], level + 1), grow(rows[~low], level + 1)
        return me

    grow(np.arange(len(x)), 0)
    table = np.array(nodes)
    return table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4]
