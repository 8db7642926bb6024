"""A small decision tree: binary splits on numeric features by Gini impurity."""

from __future__ import annotations

import numpy as np


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1) -> tuple | float:
    """A tree as nested (feature, threshold, below or equal, above), or the share of label 1 in a leaf.

    Ties go to the first feature and the lowest threshold, so equal tables grow equal trees."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best, split = 2 * share * (1 - share) * len(y) - 1e-9, None
    for feature in range(x.shape[1]):
        order = np.argsort(x[:, feature], kind="stable")
        values, ones = x[order, feature], np.cumsum(y[order])
        for i in np.flatnonzero(values[1:] > values[:-1]):
            n, m = i + 1, len(y) - i - 1
            if n < least or m < least:
                continue
            left, right = ones[i], ones[-1] - ones[i]
            impurity = 2 * left * (1 - left / n) + 2 * right * (1 - right / m)
            if impurity < best - 1e-12:
                best, split = impurity, (feature, float((values[i] + values[i + 1]) / 2))
    if split is None:
        return share
    low = x[:, split[0]] <= split[1]
    return (*split, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def predict(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x))
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if isinstance(node, tuple):
            low = x[rows, node[0]] <= node[1]
            todo += [(node[2], rows[low]), (node[3], rows[~low])]
        else:
            out[rows] = node
    return out
