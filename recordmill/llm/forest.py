"""Spanning forests of links in numpy."""

from __future__ import annotations

import numpy as np


def spanning(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between the positions a and b those that still join two trees; parent is brought up to date.

    In each turn every tree takes one new link at most, all at once, so turns grow with the logarithm of the number of trees.
    """
    out_a, out_b = [], []
    while True:
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
        x, y = parent[a], parent[b]
        on = x != y
        if not on.any():
            break
        a, b, x, y = a[on], b[on], x[on], y[on]
        low, high = np.minimum(x, y), np.maximum(x, y)
        heads, where = np.unique(high, return_index=True)
        parent[heads] = low[where]
        out_a.append(a[where])
        out_b.append(b[where])
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)
