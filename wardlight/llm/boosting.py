"""Gradient-boosted trees in numpy: histogram splits, monotonic constraints, trees flattened into node arrays.

The trees of a model lie in five arrays of equal length (feature, threshold, left, right, value) plus the roots, so a
batch of rows walks one tree with ``depth`` gathers and no Python per row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray  # -1 at leaves
    threshold: np.ndarray  # left when x <= threshold
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row of ``x`` (rows x features)."""
        total = np.full(len(x), self.base)
        every = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                down = np.where(x[every, np.maximum(f, 0)] <= self.threshold[node], self.left[node], self.right[node])
                node = np.where(f < 0, node, down)
            total += self.value[node]
        return total


def constant(base: float) -> Trees:
    """A model without trees, used when there is nothing to learn from."""
    none = np.empty(0, dtype=np.int64)
    return Trees(none, np.empty(0), none, none, np.empty(0), none, base, 0)


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 0.1, ridge: float = 1.0) -> Trees:
    """Fit log-loss trees to labels ``y`` in {0, 1}.

    ``monotone[f]`` is -1, 0 or 1: the score never rises, is free, or never falls with feature ``f``. A split on such a
    feature must order its two child values, and the mean of the two bounds what the subtrees may reach.
    ``least`` is the smallest sum of second derivatives in a leaf.
    """
    n, width = x.shape
    share = y.mean() if n else 1.0
    base = float(np.log((share * n + 0.5) / ((1 - share) * n + 0.5)))
    if n == 0 or share in (0.0, 1.0):
        return constant(base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    code = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], axis=1)
    out: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []

    def leaf(value: float) -> int:
        for k, v in zip(out, (-1, 0.0, -1, -1, value), strict=True):
            out[k].append(v)
        return len(out["value"]) - 1

    def grow(rows, g, h, low, high, left_over):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        here = float(np.clip(-total_g / (total_h + ridge), low, high))
        best = (1e-6, None)
        if left_over and total_h >= 2 * least:
            for f in range(width):
                if not len(edges[f]):
                    continue
                size = len(edges[f]) + 1
                gs = np.cumsum(np.bincount(code[rows, f], g[rows], size))[:-1]
                hs = np.cumsum(np.bincount(code[rows, f], h[rows], size))[:-1]
                a = np.clip(-gs / (hs + ridge), low, high)
                b = np.clip(-(total_g - gs) / (total_h - hs + ridge), low, high)

                def worth(value, gg, hh):
                    return -(gg * value + 0.5 * (hh + ridge) * value * value)

                gain = worth(a, gs, hs) + worth(b, total_g - gs, total_h - hs) - worth(here, total_g, total_h)
                ok = (hs >= least) & (total_h - hs >= least)
                if monotone[f]:
                    ok &= (b - a) * monotone[f] >= 0
                gain = np.where(ok, gain, -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, a[k], b[k]))
        node = leaf(here * rate)
        if best[1] is None:
            return node
        f, k, a, b = best[1]
        go = code[rows, f] <= k
        mid = (a + b) / 2
        bounds = [(low, high), (low, high)]
        if monotone[f] > 0:
            bounds = [(low, mid), (mid, high)]
        elif monotone[f] < 0:
            bounds = [(mid, high), (low, mid)]
        out["feature"][node], out["threshold"][node] = f, float(edges[f][k])
        out["left"][node] = grow(rows[go], g, h, *bounds[0], left_over - 1)
        out["right"][node] = grow(rows[~go], g, h, *bounds[1], left_over - 1)
        return node

    score = np.full(n, base)
    everything = np.arange(n)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        start = len(out["value"])
        roots.append(grow(everything, p - y, p * (1 - p), -np.inf, np.inf, depth))
        one = Trees(*(np.array(out[k]) for k in out), np.array([start]), 0.0, depth)
        score += one.score(x)
    return Trees(*(np.array(out[k]) for k in out), np.array(roots), base, depth)
