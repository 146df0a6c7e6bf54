"""Histogram gradient-boosted trees, flattened into arrays, and isotonic calibration.

Fitted on a bounded sample; trees are complete and of one depth, so that a
whole batch walks all of them with one gather a level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """``feature`` and ``threshold`` of inner nodes, tree by tree, and ``value`` of leaves."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # (trees, 2**depth)
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        n, trees = len(x), len(self.feature)
        if not trees:
            return np.full(n, self.base)
        at = np.zeros((n, trees), dtype=np.int64)
        tree, row = np.arange(trees)[None, :], np.arange(n)[:, None]
        inner = self.feature.shape[1]
        while at[0, 0] < inner if n else False:
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return self.base + self.value[tree, at - inner].sum(axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, least: float = 1.0, l2: float = 1.0) -> Trees:
    """Logistic loss, level by level; a split needs a hessian of ``least`` on both sides."""
    n, features = x.shape
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if n else 0.5
    base = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    feature = np.zeros((trees, inner), dtype=np.int64)
    threshold = np.full((trees, inner), np.inf)
    value = np.zeros((trees, inner + 1))
    if not n or y.min() == y.max():
        return Trees(feature, threshold, value, base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(features)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            local = at - first
            best, best_f, best_b = np.full(nodes, 1e-6), np.zeros(nodes, np.int64), np.full(nodes, -1)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key = local * bins + binned[f]
                gl = np.bincount(key, weights=g, minlength=nodes * bins).reshape(nodes, bins).cumsum(axis=1)
                hl = np.bincount(key, weights=h, minlength=nodes * bins).reshape(nodes, bins).cumsum(axis=1)
                g_all, h_all = gl[:, -1:], hl[:, -1:]
                gr, hr = g_all - gl, h_all - hl
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - g_all**2 / (h_all + l2)
                gain[(hl < least) | (hr < least)] = 0
                gain[:, len(e) :] = 0
                top = gain.argmax(axis=1)
                got = gain[np.arange(nodes), top]
                better = got > best
                best[better], best_f[better], best_b[better] = got[better], f, top[better]
            right = np.zeros(n, dtype=np.int64)
            for k in np.flatnonzero(best_b >= 0):
                feature[t, first + k], threshold[t, first + k] = best_f[k], edges[best_f[k]][best_b[k]]
                mine = local == k
                right[mine] = binned[best_f[k], mine] > best_b[k]
            at = 2 * at + 1 + right
        leaf = at - inner
        value[t] = -rate * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + l2)
        margin += value[t][leaf]
    return Trees(feature, threshold, value, base)


@dataclass
class Isotonic:
    """A rising step function through ``x``, linear between them."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, s: np.ndarray) -> np.ndarray:
        return np.interp(s, self.x, self.y) if len(self.x) else s


def fit_isotonic(scores: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool equal scores, then adjacent violators; then the middle of each block. The order of rows doesn't matter."""
    levels, place = np.unique(scores, return_inverse=True)
    weight, total = np.bincount(place, minlength=len(levels)), np.bincount(place, weights=y, minlength=len(levels))
    blocks: list[list[float]] = []  # sum of y, weight, sum of scores
    for s, n, v in zip(levels.tolist(), weight.tolist(), total.tolist(), strict=True):
        blocks.append([v, float(n), s * n])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return Isotonic(np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks]))


def out_of_fold(x: np.ndarray, y: np.ndarray, fold: np.ndarray, **options: float) -> np.ndarray:
    """Scores of each row by trees that were fitted without its fold."""
    out = np.zeros(len(y))
    for k in np.unique(fold):
        out[fold == k] = fit_trees(x[fold != k], y[fold != k], **options).predict(x[fold == k])
    return out
