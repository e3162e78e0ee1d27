"""Histogram gradient boosting for two classes, flattened into arrays for numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth; node i of a tree has the children 2i + 1 and 2i + 2.

    `feature` and `cut` are (trees, inner nodes), `leaf` is (trees, leaves). A row goes right
    where its value is above the cut; a node that didn't pay has an infinite cut.
    """

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, rows: np.ndarray) -> np.ndarray:
        """All rows walk down all trees at once, a level a step."""
        inner = self.feature.shape[1]
        total = np.full(len(rows), self.base)
        at_row = np.arange(len(rows))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (rows[at_row, feature[node]] > cut[node])
            total += leaf[node - inner]
        return total

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(rows), -30, 30)))


def fit(
    rows: np.ndarray,
    label: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    bins: int = 64,
    least_weight: float = 2.0,
    ridge: float = 1.0,
) -> Trees:
    """Logistic loss, second-order gains over histograms of `bins` quantile bins a feature."""
    n, width = rows.shape
    share = (label.sum() + 1.0) / (n + 2.0)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(width)] if n else []
    binned = np.stack([np.searchsorted(e, rows[:, f], "left") for f, e in enumerate(edges)]) if n else None
    inner, leaves = 2**depth - 1, 2**depth
    feature = np.zeros((trees, inner), dtype=np.int64)
    cut = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    margin = np.full(n, base)
    for t in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = p - label, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            best = np.zeros(nodes)
            for f in range(width):
                key = (node - first) * bins + binned[f]
                g = np.bincount(key, gradient, nodes * bins).reshape(nodes, bins).cumsum(1)
                h = np.bincount(key, weight, nodes * bins).reshape(nodes, bins).cumsum(1)
                gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < least_weight) | (ht - hl < least_weight)] = 0
                gain[:, len(edges[f]) :] = 0
                at = gain.argmax(1)
                top = gain[np.arange(nodes), at]
                for k in np.flatnonzero(top > best + 1e-9):
                    best[k] = top[k]
                    feature[t, first + k], cut[t, first + k] = f, edges[f][at[k]]
            node = 2 * node + 1 + (rows[np.arange(n), feature[t, node]] > cut[t, node])
        g = np.bincount(node - inner, gradient, leaves)
        h = np.bincount(node - inner, weight, leaves)
        leaf[t] = -rate * g / (h + ridge)
        margin += leaf[t, node - inner]
    return Trees(feature, cut, leaf, base)
