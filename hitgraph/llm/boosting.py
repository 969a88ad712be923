"""Gradient-boosted trees on quantile bins, with monotonic constraints, flattened into node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees' nodes in flat arrays; a leaf is its own child, so every row takes `depth` steps."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Forest:
    """Boost on the logistic loss.  monotone: -1, 0, 1 for each feature.  Deterministic.

    A split against a feature's sign is not taken; the mid value of the two sides bounds all leaves below,
    so a whole tree, and their sum, is monotone in that feature.  With no rows the score is 0 everywhere.
    """
    n, k = x.shape if x.size else (0, len(monotone))
    nodes: list[list[float]] = []  # feature, cut, left, right, value
    roots: list[int] = []
    mean = float(np.clip((y.sum() + 1) / (n + 2), 1e-6, 1 - 1e-6))
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
    coded = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(k)], 1) if n else np.zeros((0, k), int)
    margin = np.full(n, base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), low, high))
        me = len(nodes)
        nodes.append([0, np.inf, me, me, value * rate])
        if level == depth or len(rows) < 4:
            out[rows] = value * rate
            return me
        best = (1e-6, -1, -1, 0.0, 0.0)
        gs, hs = g[rows].sum(), h[rows].sum()
        for j in range(k):
            m = len(cuts[j])
            if not m:
                continue
            gl = np.cumsum(np.bincount(coded[rows, j], g[rows], m + 1))[:-1]
            hl = np.cumsum(np.bincount(coded[rows, j], h[rows], m + 1))[:-1]
            vl = np.clip(-gl / (hl + l2), low, high)
            vr = np.clip(-(gs - gl) / (hs - hl + l2), low, high)
            gain = -(gl * vl + 0.5 * (hl + l2) * vl**2) - ((gs - gl) * vr + 0.5 * (hs - hl + l2) * vr**2) + (gs * value + 0.5 * (hs + l2) * value**2)
            ok = (hl >= least) & (hs - hl >= least) & ((vr - vl) * monotone[j] >= 0)
            gain = np.where(ok, gain, -np.inf)
            b = int(np.argmax(gain))
            if gain[b] > best[0]:
                best = (float(gain[b]), j, b, float(vl[b]), float(vr[b]))
        _, j, b, vl_, vr_ = best
        if j < 0:
            out[rows] = value * rate
            return me
        go = coded[rows, j] <= b
        mid, sign = (vl_ + vr_) / 2, monotone[j]
        a = grow(rows[go], g, h, level + 1, mid if sign < 0 else low, mid if sign > 0 else high)
        c = grow(rows[~go], g, h, level + 1, mid if sign > 0 else low, mid if sign < 0 else high)
        nodes[me] = [j, float(cuts[j][b]), a, c, 0.0]
        return me

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        out = np.zeros(n)
        roots.append(grow(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-9), 0, -4.0, 4.0))
        margin = margin + out
    if not roots:
        nodes, roots, base = [[0, np.inf, 0, 0, 0.0]], [0], base if n else 0.0
    a = np.array(nodes)
    return Forest(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots), depth, base)
