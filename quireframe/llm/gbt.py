"""Gradient-boosted trees with the logistic loss: histogram training on a bounded sample, scoring by flat node arrays.

``fit`` grows depth-limited trees on quantile-binned features (one histogram per node and feature).  A feature may be
constrained to push the score only up (+1) or only down (-1): splits against the direction are refused and the children's
values are kept on their side of the midpoint, so the whole model is monotone in it.  ``Trees`` stores all trees as four
arrays (feature, threshold, child, value), and scoring walks a matrix of rows through them level by level without a loop
over rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray  # int32 per node; leaves point at feature 0
    threshold: np.ndarray  # go right when x > threshold; +inf in leaves
    child: np.ndarray  # left child; the right one follows; leaves point at themselves
    value: np.ndarray  # of leaves
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(x.shape[0], self.bias)
        rows = np.arange(x.shape[0])
        for root in self.roots:
            at = np.full(x.shape[0], root, np.int64)
            for _ in range(self.depth):
                at = self.child[at] + (x[rows, self.feature[at]] > self.threshold[at])
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def constant(p: float) -> Trees:
    """A model that gives every row the same score."""
    p = min(max(p, 1e-6), 1 - 1e-6)
    z = np.zeros(0)
    return Trees(z.astype(np.int32), z, z.astype(np.int64), z, z.astype(np.int64), 0, float(np.log(p / (1 - p))))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, ridge: float = 1.0, monotone: dict[int, int] | None = None) -> Trees:
    """``x``: finite rows by features, ``y``: 0 or 1.  One class alone, or no rows, gives a constant model."""
    y = np.asarray(y, float)
    if y.size == 0 or y.min() == y.max():
        return constant(float(y.mean()) if y.size else 0.5)
    monotone = monotone or {}
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    code = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(m)], 1)  # code > k  <=>  x > cuts[k]
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(n, base)
    feature, threshold, child, value, roots = [], [], [], [], []

    def node(v: float) -> int:
        i = len(feature)
        feature.append(0)
        threshold.append(np.inf)
        child.append(i)
        value.append(v)
        return i

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        root = node(0.0)
        roots.append(root)
        todo = [(root, np.arange(n), -np.inf, np.inf, 0)]
        while todo:
            at, rows, low, high, level = todo.pop()
            sg, sh = g[rows].sum(), h[rows].sum()
            v = float(np.clip(sg / (sh + ridge), low, high))
            value[at] = rate * v
            best = (1e-6, -1, -1, 0.0, 0.0)
            if level < depth and rows.size >= 2 * least:
                for j in range(m):
                    if not cuts[j].size:
                        continue
                    c, k = code[rows, j], cuts[j].size + 1
                    lg, lh, lc = (np.cumsum(np.bincount(c, weights=q, minlength=k))[:-1] for q in (g[rows], h[rows], None))
                    rg, rh, rc = sg - lg, sh - lh, rows.size - lc
                    lv, rv = np.clip(lg / (lh + ridge), low, high), np.clip(rg / (rh + ridge), low, high)
                    gain = 2 * lg * lv - (lh + ridge) * lv**2 + 2 * rg * rv - (rh + ridge) * rv**2 - (2 * sg * v - (sh + ridge) * v * v)
                    ok = (lc >= least) & (rc >= least)
                    if monotone.get(j):
                        ok &= (rv - lv) * monotone[j] >= 0
                    gain = np.where(ok, gain, -1.0)
                    i = int(gain.argmax())
                    if gain[i] > best[0] + 1e-12:
                        best = (float(gain[i]), j, i, float(lv[i]), float(rv[i]))
            if best[1] < 0:
                margin[rows] += value[at]
                continue
            _, j, i, lv, rv = best
            left = node(0.0)
            right = node(0.0)
            feature[at], threshold[at], child[at] = j, float(cuts[j][i]), left
            goes = code[rows, j] > i
            l_range, r_range = (low, high), (low, high)
            if monotone.get(j):
                mid = (lv + rv) / 2
                l_range, r_range = ((low, mid), (mid, high)) if monotone[j] > 0 else ((mid, high), (low, mid))
            todo.append((left, rows[~goes], *l_range, level + 1))
            todo.append((right, rows[goes], *r_range, level + 1))
    return Trees(np.array(feature, np.int32), np.array(threshold), np.array(child, np.int64), np.array(value), np.array(roots, np.int64), depth, base)
