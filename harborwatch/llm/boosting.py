"""Gradient-boosted trees for two classes on the driver's bounded sample, and their evaluation over numpy arrays."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Forest(NamedTuple):
    feature: np.ndarray  # tree x inner node, heap order
    cut: np.ndarray  # go right where the feature is above
    leaf: np.ndarray  # tree x leaf
    base: float


def train(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32,
    ridge: float = 2.0,
) -> Forest:
    """Newton boosting of the logistic loss; cuts are quantiles of each feature."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    width = bins + 1
    p0 = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    out = np.full(n, base)
    inner = (1 << depth) - 1
    features, values, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-out))
        g, h = (y - p) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        node = np.zeros(n, np.int64)
        for level in range(depth):
            size, first = 1 << level, (1 << level) - 1
            gain, which = np.zeros(size), np.full(size, -1)
            at = np.zeros(size, np.int64)
            for j in range(m):
                key = (node - first) * width + binned[:, j]
                gs = np.bincount(key, g, size * width).reshape(size, width).cumsum(axis=1)
                hs = np.bincount(key, h, size * width).reshape(size, width).cumsum(axis=1)
                left = gs**2 / (hs + ridge)
                right = (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + ridge)
                better = left + right - gs[:, -1:] ** 2 / (hs[:, -1:] + ridge)
                k = better[:, : len(cuts[j])].argmax(axis=1) if len(cuts[j]) else np.zeros(size, np.int64)
                best = better[np.arange(size), k] if len(cuts[j]) else np.zeros(size)
                win = best > gain + 1e-9
                gain[win], which[win], at[win] = best[win], j, k[win]
            for s in range(size):
                if which[s] >= 0:
                    features[t, first + s], values[t, first + s] = which[s], cuts[which[s]][at[s]]
            node = 2 * node + 1 + (x[np.arange(n), features[t, node]] > values[t, node])
        place = node - inner
        leaves[t] = rate * np.bincount(place, g, inner + 1) / (np.bincount(place, h, inner + 1) + ridge)
        out += leaves[t, place]
    return Forest(features, values, leaves, base)


def predict(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Log-odds."""
    out = np.full(len(x), forest.base)
    rows, inner = np.arange(len(x)), forest.feature.shape[1]
    for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf):
        node = np.zeros(len(x), np.int64)
        while len(x) and node[0] < inner:
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        out += leaf[node - inner]
    return out
