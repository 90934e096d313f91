"""Gradient-boosted trees for a yes or no, on a block of rows that one task holds (a row a date): second-order steps, shrunk and penalised leaves.

A walk forward fits many small models, one a refit block; each is a group of its own, so all are fitted at once on the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Node:
    """A leaf of a weight, or a split: rows below the cut go left."""

    weight: float
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None


@dataclass
class BoostedTrees:
    """Probability of 1. ``positive``: the weight of rows with target 1. Missing values aren't taken."""

    trees: int = 400
    depth: int = 3
    rate: float = 0.03
    rows: float = 0.8
    columns: float = 0.8
    least_weight: float = 1.0
    ridge: float = 1.0
    lasso: float = 0.0
    positive: float = 1.0
    seed: int = 42
    grown: list[Node] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rng, n, d = np.random.default_rng(self.seed), *x.shape
        weight, score = np.where(y > 0, self.positive, 1.0), np.zeros(len(y))
        self.grown, self.gain, self.uses = [], np.zeros(d), np.zeros(d)
        order = np.argsort(x, axis=0, kind="stable")
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            taken = rng.random(n) < self.rows
            picked = np.sort(rng.choice(d, max(1, round(self.columns * d)), replace=False))
            root = self._grow(x, weight * (p - y), weight * p * (1 - p), taken, order, picked, self.depth)
            self.grown.append(root)
            score += self.rate * _weights(root, x)
        return self

    def leaf(self, g: float, h: float) -> float:
        return -np.sign(g) * max(abs(g) - self.lasso, 0.0) / (h + self.ridge)

    def worth(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return np.maximum(np.abs(g) - self.lasso, 0.0) ** 2 / (h + self.ridge)

    def _grow(self, x, g, h, inside, order, picked, depth) -> Node:
        total_g, total_h = g[inside].sum(), h[inside].sum()
        node = Node(self.leaf(total_g, total_h))
        if depth == 0 or inside.sum() < 2:
            return node
        best = 0.0
        for j in picked:
            rows = order[:, j][inside[order[:, j]]]
            v, left_g, left_h = x[rows, j], np.cumsum(g[rows])[:-1], np.cumsum(h[rows])[:-1]
            gain = (
                self.worth(left_g, left_h)
                + self.worth(total_g - left_g, total_h - left_h)
                - self.worth(np.array(total_g), np.array(total_h))
            ) / 2
            fit = (v[1:] > v[:-1]) & (left_h >= self.least_weight) & (total_h - left_h >= self.least_weight)
            gain = np.where(fit, gain, 0.0)
            if len(gain) and gain[at := int(gain.argmax())] > best + 1e-12:
                best, node.feature, node.cut = float(gain[at]), int(j), (v[at] + v[at + 1]) / 2
        if node.feature >= 0:
            self.gain[node.feature] += best
            self.uses[node.feature] += 1
            low = x[:, node.feature] < node.cut
            node.left = self._grow(x, g, h, inside & low, order, picked, depth - 1)
            node.right = self._grow(x, g, h, inside & ~low, order, picked, depth - 1)
        return node

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.zeros(len(x))
        for root in self.grown:
            score += self.rate * _weights(root, x)
        return 1 / (1 + np.exp(-score))

    def importance(self) -> np.ndarray:
        """Each column's mean gain of a split, as a share of all columns'."""
        mean = np.divide(self.gain, self.uses, out=np.zeros_like(self.gain), where=self.uses > 0)
        return mean / mean.sum() if mean.sum() > 0 else mean


def _weights(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.weight)
    low, out = x[:, node.feature] < node.cut, np.empty(len(x))
    out[low], out[~low] = _weights(node.left, x[low]), _weights(node.right, x[~low])
    return out
