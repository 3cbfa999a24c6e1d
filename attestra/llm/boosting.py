"""Gradient-boosted trees in numpy: binned features, logistic loss, trees of fixed depth."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Trees(NamedTuple):
    edges: list[np.ndarray]         # per feature: upper bin edges
    feature: np.ndarray             # trees x inner nodes
    cut: np.ndarray                 # trees x inner nodes: bins up to this one go left
    leaf: np.ndarray                # trees x leaves
    start: float


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32,
        l2: float = 1.0, least: float = 4.0) -> Trees:
    """Second-order boosting; at each level every node takes the best of all (feature, bin) cuts."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(m)]
    b = binned(x, edges)
    p0 = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    start = float(np.log(p0 / (1 - p0)))
    raw = np.full(n, start)
    inner, leaves = 2 ** depth - 1, 2 ** depth
    features, cuts, values = (np.zeros((trees, inner), np.int64), np.full((trees, inner), 255, np.int64),
                              np.zeros((trees, leaves)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            width = 2 ** level
            best = np.full(width, 1e-6)
            base = width - 1
            for j in range(m):
                at = node * bins + b[:, j]
                sg = np.bincount(at, g, width * bins).reshape(width, bins)
                sh = np.bincount(at, h, width * bins).reshape(width, bins)
                gl, hl = sg.cumsum(1), sh.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl ** 2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt ** 2 / (ht + l2)
                gain[(hl < least / 4) | (ht - hl < least / 4)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                for w in np.flatnonzero(top > best):
                    best[w], features[t, base + w], cuts[t, base + w] = top[w], j, k[w]
            f, c = features[t, base + node], cuts[t, base + node]
            node = 2 * node + (b[np.arange(n), f] > c)
        values[t] = -rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + l2)
        raw += values[t][node]
    return Trees(edges, features, cuts, values, start)


def predict(model: Trees, x: np.ndarray) -> np.ndarray:
    b = binned(x, model.edges)
    rows = np.arange(len(x))
    raw = np.full(len(x), model.start)
    depth = int(np.log2(model.leaf.shape[1]))
    for feature, cut, leaf in zip(model.feature, model.cut, model.leaf):
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            at = 2 ** level - 1 + node
            node = 2 * node + (b[rows, feature[at]] > cut[at])
        raw += leaf[node]
    return 1 / (1 + np.exp(-raw))
