"""A linear-chain conditional random field with two labels and binary features, trained and decoded with NumPy."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Crf:
    """weights: for each feature, the log odds that it adds to label 1; step[a][b]: of label b after a; start: of the first."""

    weights: dict[str, float]
    step: tuple[tuple[float, float], tuple[float, float]]
    start: tuple[float, float]

    @functools.cached_property
    def names(self) -> frozenset[str]:
        """The class names that have a weight; others need not be looked for."""
        return frozenset(f[5:] for f in self.weights if f.startswith("name:"))

    def decode(self, sequence: list[list[str]]) -> list[int]:
        """The likeliest labels, by Viterbi; features that training has not seen count nothing."""
        if not sequence:
            return []
        w, ((s00, s01), (s10, s11)) = self.weights, self.step
        back = []
        zero, one = self.start[0], self.start[1] + sum(w.get(f, 0.0) for f in sequence[0])
        for feats in sequence[1:]:
            e = sum(w.get(f, 0.0) for f in feats)
            from0, from1 = zero + s01, one + s11
            to0, to1 = zero + s00, one + s10
            back.append((int(to1 > to0), int(from1 > from0)))
            zero, one = max(to0, to1), max(from0, from1) + e
        label = int(one > zero)
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 200, rate: float = 0.1, l2: float = 1e-4) -> Crf:
    """Maximises the labels' likelihood, less l2 times the squared weights, by Adam over all pages at once."""
    pages = [p for p in pages if p[0]]
    index: dict[str, int] = {}
    n, most = len(pages), max(len(p[1]) for p in pages)
    rows, cols = [], []
    y = np.full((n, most), -1)
    for i, (feats, labels) in enumerate(pages):
        y[i, : len(labels)] = labels
        for t, fs in enumerate(feats):
            for f in fs:
                rows.append(i * most + t)
                cols.append(index.setdefault(f, len(index)))
    rows, cols = np.array(rows), np.array(cols)
    real = y >= 0
    total = int(real.sum())
    one = (y == 1).astype(float)
    pairs = np.zeros((2, 2))
    both = real[:, 1:]
    for a in (0, 1):
        for b in (0, 1):
            pairs[a, b] = np.sum(both & (y[:, :-1] == a) & (y[:, 1:] == b))
    first = np.array([np.sum(y[:, 0] == 0), np.sum(y[:, 0] == 1)], float)
    theta = np.zeros(len(index) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        w, step, start = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        e = np.zeros((n, most, 2))
        e[..., 1] = np.bincount(rows, w[cols], n * most).reshape(n, most)
        alpha = np.empty_like(e)
        alpha[:, 0] = start + e[:, 0]
        for t in range(1, most):
            nxt = np.logaddexp(alpha[:, t - 1, :1] + step[0], alpha[:, t - 1, 1:] + step[1]) + e[:, t]
            alpha[:, t] = np.where(real[:, t, None], nxt, alpha[:, t - 1])
        log_z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        beta = np.zeros_like(e)
        expected = np.zeros((2, 2))
        for t in range(most - 2, -1, -1):
            ahead = e[:, t + 1] + beta[:, t + 1]
            now = np.logaddexp(step[:, 0] + ahead[:, :1], step[:, 1] + ahead[:, 1:])
            on = real[:, t + 1]
            p = np.exp(alpha[on, t, :, None] + step + ahead[on, None, :] - log_z[on, None, None])
            expected += p.sum(0)
            beta[:, t] = np.where(on[:, None], now, 0.0)
        prob = np.exp(alpha + beta - log_z[:, None, None])
        gap = np.where(real, one - prob[..., 1], 0.0)
        grad = np.concatenate((np.bincount(cols, gap.ravel()[rows], len(index)), (pairs - expected).ravel(), first - prob[:, 0].sum(0)))
        grad = grad / total - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    assert all(map(math.isfinite, theta))
    s = theta[-6:-2].reshape(2, 2)
    return Crf({f: float(theta[i]) for f, i in index.items()}, ((float(s[0, 0]), float(s[0, 1])), (float(s[1, 0]), float(s[1, 1]))), (float(theta[-2]), float(theta[-1])))
