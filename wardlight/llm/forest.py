"""Random forest in numpy: bootstrap samples, random features per split, trees flattened into node arrays."""

from __future__ import annotations

import numpy as np

from wardlight.llm.boosting import Trees, constant


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, bins: int = 48, least: int = 3, seed: int = 5) -> Trees:
    """Forest for labels ``y`` in {0, 1}; ``score`` is the mean over trees of the share of positives in the leaf."""
    n, width = x.shape
    if n == 0 or y.min() == y.max():
        return constant(float(y.mean()) if n else 0.0)
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    code = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], axis=1)
    out: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    some = max(1, int(np.sqrt(width)) + 1)
    roots = []

    def grow(rows: np.ndarray, left_over: int) -> int:
        share = y[rows].mean()
        node = len(out["value"])
        for k, v in zip(out, (-1, 0.0, -1, -1, share / trees), strict=True):
            out[k].append(v)
        best = (1e-9, None)
        if left_over and len(rows) >= 2 * least and 0 < share < 1:
            for f in rng.permutation(width)[:some]:
                size = len(edges[f]) + 1
                total = np.cumsum(np.bincount(code[rows, f], minlength=size))[:-1]
                hits = np.cumsum(np.bincount(code[rows, f], y[rows], size))[:-1]
                ok = (total >= least) & (len(rows) - total >= least)
                if not ok.any():
                    continue
                a, b = np.maximum(total, 1), np.maximum(len(rows) - total, 1)
                more = y[rows].sum() - hits
                impurity = hits * (1 - hits / a) + more * (1 - more / b)
                gain = np.where(ok, len(rows) * share * (1 - share) - impurity, -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k))
        if best[1] is not None:
            f, k = best[1]
            go = code[rows, f] <= k
            out["feature"][node], out["threshold"][node] = int(f), float(edges[f][k])
            out["left"][node] = grow(rows[go], left_over - 1)
            out["right"][node] = grow(rows[~go], left_over - 1)
        return node

    for _ in range(trees):
        roots.append(grow(rng.integers(0, n, n), depth))
    return Trees(*(np.array(out[k]) for k in out), np.array(roots), 0.0, depth)
