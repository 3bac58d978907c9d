"""Gradient-boosted trees with a logistic loss over binned dense features, and isotonic calibration.

Training takes a bounded sample on the driver; the model is a few small arrays that
travel with the scoring function.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: feature and threshold by node, value by leaf."""

    depth: int
    base: float = 0.0
    feature: list = field(default_factory=list)
    threshold: list = field(default_factory=list)
    value: list = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Boost trees on the gradient and curvature of the logistic loss. All of one class: a constant."""
    n, m = x.shape
    p = float(np.clip((y.sum() + 0.5) / (n + 1), 1e-6, 1 - 1e-6))
    model = Trees(depth, float(np.log(p / (1 - p))))
    if n == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.concatenate([np.quantile(c, np.linspace(0, 1, bins)[1:-1]), np.quantile(c[c > c.min()], np.linspace(0, 1, bins)[:-1]) if (c > c.min()).any() else []])) for c in x.T]
    width = max(len(e) for e in edges) + 1
    code = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    margin = np.full(n, model.base)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, np.maximum(q * (1 - q), 1e-9)
        inner = 2**depth - 1
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = node - first
            best, where = np.zeros(many), np.full((many, 2), -1)
            for j in range(m):
                cell = at * width + code[:, j]
                gs = np.bincount(cell, g, many * width).reshape(many, width).cumsum(axis=1)
                hs = np.bincount(cell, h, many * width).reshape(many, width).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                counts = np.bincount(cell, minlength=many * width).reshape(many, width).cumsum(axis=1)
                gain[(counts < least) | (counts[:, -1:] - counts < least)] = 0
                k = gain[:, : max(1, len(edges[j]))].argmax(axis=1)
                top = gain[np.arange(many), k]
                better = top > best + 1e-12
                best[better] = top[better]
                where[better] = np.stack([np.full(many, j), k], axis=1)[better]
            right = np.zeros(n, bool)
            for i in range(many):
                j, k = where[i]
                if j >= 0:
                    feature[first + i], threshold[first + i] = j, edges[j][k]
                    mine = at == i
                    right[mine] = code[mine, j] > k
            node = 2 * node + 1 + right
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        margin += value[leaf]
        model.feature.append(feature)
        model.threshold.append(threshold)
        model.value.append(value)
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (margin, probability), rising, with one success and one failure spread over the ends."""
    order = np.argsort(margin, kind="stable")
    xs, first = np.unique(margin[order], return_index=True)
    sums, sizes = np.add.reduceat(y[order].astype(float), first), np.diff(np.append(first, len(order)))
    blocks: list[list[float]] = []  # sum, size, from, to
    for x, s, k in zip(xs, sums, sizes, strict=True):
        blocks.append([s, k, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, k2, _, to = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + k2, blocks[-1][2], to]
    knots = [(x, (s + 0.5) / (k + 1)) for s, k, a, b in blocks for x in ((a, b) if b > a else (a,))]
    x, p = np.array([k[0] for k in knots]), np.maximum.accumulate([k[1] for k in knots])
    return x, p
