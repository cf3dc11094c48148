"""A small random forest: grown in numpy on a bounded table, applied as a SQL expression."""

from __future__ import annotations

import numpy as np


def _grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, least: int):
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return share
    best = None
    for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5)), replace=False):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0.1, 0.9, 9))):
            left = x[:, f] <= cut
            n = left.sum()
            if n < least or len(y) - n < least:
                continue
            p, q = y[left].mean(), y[~left].mean()
            impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
            if best is None or impurity < best[0]:
                best = (impurity, int(f), float(cut), left)
    if best is None:
        return share
    _, f, cut, left = best
    return f, cut, _grow(x[left], y[left], depth - 1, rng, least), _grow(x[~left], y[~left], depth - 1, rng, least)


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 5, least: int = 5, seed: int = 5) -> list:
    """Each tree: a share, or (feature, cut, tree where feature <= cut, tree elsewhere)."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        own = rng.integers(0, len(y), len(y))
        out.append(_grow(x[own], y[own].astype(float), depth, rng, least))
    return out


def forest_sql(forest: list, features: list[str]) -> str:
    """The mean of the trees' shares, over columns of these names."""

    def tree(t) -> str:
        if isinstance(t, float):
            return f"{t:.6f}D"
        f, cut, low, high = t
        return f"CASE WHEN {features[f]} <= {cut:.9g}D THEN {tree(low)} ELSE {tree(high)} END"

    return f"({' + '.join(tree(t) for t in forest)}) / {len(forest)}"


def forest_score(forest: list, x: np.ndarray) -> np.ndarray:
    def one(t, row) -> float:
        while not isinstance(t, float):
            t = t[2] if row[t[0]] <= t[1] else t[3]
        return t

    return np.asarray([sum(one(t, row) for t in forest) / len(forest) for row in x])
