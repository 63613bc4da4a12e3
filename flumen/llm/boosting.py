"""Gradient-boosted trees for a few thousand examples: logistic loss, depth-limited, exact splits."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def fit_line(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (x, y), by Newton's method."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = sigmoid(a @ w)
        grad = a.T @ (p - y) + ridge * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


class BoostedTrees:
    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, least: int = 5):
        self.trees, self.depth, self.rate, self.ridge, self.least = trees, depth, rate, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        self.start = float(np.log(mean / (1 - mean)))
        margin = np.full(len(y), self.start)
        self.nodes: list[list[tuple]] = []
        for _ in range(self.trees):
            p = sigmoid(margin)
            nodes: list = []
            value = np.zeros(len(y))
            self._grow(x, p - y, p * (1 - p), np.arange(len(y)), 0, nodes, value)
            self.nodes.append(nodes)
            margin += self.rate * value
        return self

    def _grow(self, x, g, h, rows, level, nodes, value) -> int:
        """Adds a node: (feature, threshold, left, right, None) or (-1, 0, 0, 0, leaf value)."""
        here = len(nodes)
        nodes.append(None)
        leaf = -g[rows].sum() / (h[rows].sum() + self.ridge)
        best = None
        if level < self.depth and len(rows) >= 2 * self.least:
            whole = g[rows].sum() ** 2 / (h[rows].sum() + self.ridge)
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v = x[order, f]
                gl, hl = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
                gain = gl**2 / (hl + self.ridge) + (g[rows].sum() - gl) ** 2 / (h[rows].sum() - hl + self.ridge) - whole
                gain[v[1:] == v[:-1]] = -1
                gain[: self.least - 1] = gain[len(gain) - self.least + 1 :] = -1
                k = int(np.argmax(gain))
                if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                    best = (gain[k], f, (v[k] + v[k + 1]) / 2)
        if best is None:
            nodes[here] = (-1, 0.0, 0, 0, leaf)
            value[rows] = leaf
            return here
        _, f, cut = best
        left = self._grow(x, g, h, rows[x[rows, f] <= cut], level + 1, nodes, value)
        right = self._grow(x, g, h, rows[x[rows, f] > cut], level + 1, nodes, value)
        nodes[here] = (f, cut, left, right, 0.0)
        return here

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for nodes in self.nodes:
            at = np.zeros(len(x), np.int64)
            f = np.array([n[0] for n in nodes])
            cut, left, right, leaf = (np.array([n[k] for n in nodes]) for k in (1, 2, 3, 4))
            for _ in range(self.depth):
                feature = f[at]
                inner = feature >= 0
                go = x[np.arange(len(x)), np.maximum(feature, 0)] <= cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at).astype(np.int64)
            total += self.rate * leaf[at]
        return total
