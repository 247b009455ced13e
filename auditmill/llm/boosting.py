"""Gradient-boosted trees with logistic loss, and isotonic calibration, for small dense tables.

Training happens on the driver over a bounded sample; scoring is plain numpy
and runs inside Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            below = x[np.arange(len(x)), np.maximum(f, 0)] <= self.cut[at]
            at = np.where(inner, np.where(below, self.left[at], self.right[at]), at)


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: float, ridge: float, rises: np.ndarray) -> Tree:
    """A tree on gradients; where ``rises`` is 1 (-1) its value never falls (rises) as the feature grows."""
    feature, cut, left, right, value = [], [], [], [], []

    def node(rows: np.ndarray, d: int, low: float, high: float) -> int:
        me = len(feature)
        gs, hs = g[rows].sum(), h[rows].sum()
        feature.append(-1)
        cut.append(0.0)
        left.append(0)
        right.append(0)
        value.append(float(np.clip(gs / (hs + ridge), low, high)))
        best = (1e-6, -1, 0.0, 0.0)
        if d:
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v = x[order, f]
                if v[0] == v[-1]:
                    continue
                cg, ch = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
                below, above = cg / (ch + ridge), (gs - cg) / (hs - ch + ridge)
                ok = (v[1:] > v[:-1]) & (ch >= least) & (hs - ch >= least) & (rises[f] * (above - below) >= 0)
                if ok.any():
                    gain = np.where(ok, below * cg + above * (gs - cg) - gs**2 / (hs + ridge), -np.inf)
                    i = int(np.argmax(gain))
                    if gain[i] > best[0]:
                        best = (float(gain[i]), f, float((v[i] + v[i + 1]) / 2), float((below[i] + above[i]) / 2))
        if best[1] >= 0:
            _, f, at, middle = best
            feature[me], cut[me] = f, at
            below = x[rows, f] <= at
            middle = float(np.clip(middle, low, high))
            ends = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(rises[f])]
            left[me] = node(rows[below], d - 1, *ends[0])
            right[me] = node(rows[~below], d - 1, *ends[1])
        return me

    node(np.arange(len(x)), depth, -np.inf, np.inf)
    return Tree(np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value))


@dataclass
class Boosted:
    """A sum of trees on the log odds, then steps from score to probability."""

    base: float
    rate: float
    trees: list[Tree] = field(default_factory=list)
    at: np.ndarray = field(default_factory=lambda: np.zeros(0))
    level: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += self.rate * t.predict(x)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        return np.interp(m, self.at, self.level) if len(self.at) else 1 / (1 + np.exp(-m))


def fit_margin(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, least: float = 0.5, ridge: float = 1.0, rises: np.ndarray | None = None) -> Boosted:
    rises = np.zeros(x.shape[1], int) if rises is None else rises
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = Boosted(float(np.log(p / (1 - p))), rate)
    m = np.full(len(y), model.base)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-m))
        t = _grow(x, y - q, q * (1 - q), depth, least, ridge, rises)
        model.trees.append(t)
        m += rate * t.predict(x)
    return model


def _pooled(blocks: list[list[float]]) -> list[list[float]]:
    """Blocks of (sum of scores, sum of values, rows) joined until their means don't decrease."""
    out: list[list[float]] = []
    for b in blocks:
        out.append(list(b))
        while len(out) > 1 and out[-2][1] / out[-2][2] >= out[-1][1] / out[-1][2]:
            last = out.pop()
            out[-1] = [x + y for x, y in zip(out[-1], last, strict=True)]
    return out


def isotonic(score: np.ndarray, y: np.ndarray, prior: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (scores, non-decreasing levels).

    Equal scores are one block from the start. Each block of the result gets
    ``prior`` rows of each kind, which keeps levels off 0 and 1; what no longer
    increases then is joined again.
    """
    at, of = np.unique(score, return_inverse=True)
    n, v = np.bincount(of).astype(float), np.bincount(of, y)
    blocks = _pooled([[s * k, p, k] for s, p, k in zip(at, v, n, strict=True)])
    where = [b[0] / b[2] for b in blocks]
    drawn = _pooled([[s * (b[2] + 2 * prior), b[1] + prior, b[2] + 2 * prior] for s, b in zip(where, blocks, strict=True)])
    return np.array([b[0] / b[2] for b in drawn]), np.array([b[1] / b[2] for b in drawn])


def fit(x: np.ndarray, y: np.ndarray, groups: np.ndarray, folds: int = 5, **how) -> Boosted:
    """Trees on all rows, calibrated on scores from folds that keep a group together."""
    model = fit_margin(x, y, **how)
    held = np.zeros(len(y))
    fold = groups % folds
    for k in range(folds):
        test = fold == k
        if test.any() and (~test).any() and len(set(y[~test])) > 1:
            held[test] = fit_margin(x[~test], y[~test], **how).margin(x[test])
        else:
            held[test] = model.margin(x[test])
    model.at, model.level = isotonic(held, y, prior=0.5)
    return model
