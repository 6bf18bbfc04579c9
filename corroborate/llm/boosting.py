"""Gradient-boosted trees for a 0/1 label: training on a bounded sample, scoring from flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """All nodes of all trees in flat arrays; a leaf has feature -1. ``roots``: first node of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1 for each row of x; rows go left where x <= threshold."""
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                go = np.where(x[row, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(f < 0, at, go)
            out += self.value[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 64, smooth: float = 1.0, least: float = 5.0) -> Trees:
    """Second-order boosting of the logistic loss on binned features.

    ``monotone``: +1, -1 or 0 for each feature. A split on a constrained feature must order its children's
    values, and both children's subtrees keep to their side of the midpoint, so the whole sum is monotone.
    With no rows, or rows of one label, there are no trees: the base is that label's smoothed log-odds.
    """
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(share / (1 - share)))
    nodes: list[list] = []
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        margin = np.full(len(y), base)

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            g, h = gradient[rows].sum(), hessian[rows].sum()
            me = len(nodes)
            nodes.append([-1, 0.0, me, me, rate * float(np.clip(-g / (h + smooth), low, high))])
            if level == 0 or len(rows) < 2 * least:
                return me
            best = (1e-6, None)
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                c = code[rows, f]
                gl = np.cumsum(np.bincount(c, gradient[rows], len(cut) + 1))[:-1]
                hl = np.cumsum(np.bincount(c, hessian[rows], len(cut) + 1))[:-1]
                nl = np.cumsum(np.bincount(c, minlength=len(cut) + 1))[:-1]
                vl, vr = np.clip(-gl / (hl + smooth), low, high), np.clip(-(g - gl) / (h - hl + smooth), low, high)
                gain = gl**2 / (hl + smooth) + (g - gl) ** 2 / (h - hl + smooth) - g**2 / (h + smooth)
                gain[(nl < least) | (len(rows) - nl < least) | (monotone[f] * (vr - vl) < 0)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (f, k, vl[k], vr[k]))
            if best[1] is None:
                return me
            f, k, vl, vr = best[1]
            middle = (vl + vr) / 2
            to_left, to_right = ((low, middle), (middle, high)) if monotone[f] > 0 else ((middle, high), (low, middle)) if monotone[f] < 0 else ((low, high), (low, high))
            goes = code[rows, f] <= k
            a = grow(rows[goes], level - 1, *to_left)
            b = grow(rows[~goes], level - 1, *to_right)
            nodes[me][:4] = [f, float(cuts[f][k]), a, b]
            return me

        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            gradient, hessian = p - y, p * (1 - p)
            first = len(nodes)
            roots.append(grow(np.arange(len(y)), depth, -np.inf, np.inf))
            one = _flat(nodes[first:], [0], 0.0, depth, first)
            margin += one.margin(x)
    return _flat(nodes, roots, base, depth, 0)


def _flat(nodes: list[list], roots: list[int], base: float, depth: int, first: int) -> Trees:
    columns = list(zip(*nodes)) if nodes else [[]] * 5
    feature, left, right = (np.array(columns[k], np.int64) for k in (0, 2, 3))
    return Trees(feature, np.array(columns[1], float), left - first, right - first, np.array(columns[4], float), np.array(roots, np.int64), base, depth)
