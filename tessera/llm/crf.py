"""A linear-chain conditional random field with two labels over numpy arrays: forward-backward and training.

A batch is one stream of items with a flag where a new sequence starts. The field has an emission score for label 1
(label 0's is 0), transition scores, and start scores. Forward and backward messages are products of 2 x 2 matrices along
the stream; the matrix of a sequence's first item has equal columns, which forgets what came before, so sequences of any
length and number are handled alike. The products are taken blockwise, so that numpy works on many blocks at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

_BLOCK = 64


def _step(m: list[np.ndarray], by: list[np.ndarray]) -> list[np.ndarray]:
    """by @ m for arrays of 2 x 2 matrices (a b; c d), scaled to a largest entry of 1."""
    a, b, c, d = by[0] * m[0] + by[1] * m[2], by[0] * m[1] + by[1] * m[3], by[2] * m[0] + by[3] * m[2], by[2] * m[1] + by[3] * m[3]
    top = np.maximum(np.maximum(a, b), np.maximum(c, d))
    return [a / top, b / top, c / top, d / top]


def scan(m: list[np.ndarray], start: tuple[float, float] = (0.5, 0.5)) -> tuple[np.ndarray, np.ndarray]:
    """The vectors m[t] @ ... @ m[0] @ start for every t, scaled to a sum of 1."""
    n = len(m[0])
    if n <= 2 * _BLOCK:
        out, v = np.empty((2, n)), start
        for t, (a, b, c, d) in enumerate(zip(*(x.tolist() for x in m), strict=True)):
            p, q = a * v[0] + b * v[1], c * v[0] + d * v[1]
            v = out[:, t] = p / (p + q), q / (p + q)
        return out[0], out[1]
    blocks = -(-n // _BLOCK)
    padded = [np.concatenate([x, np.full(blocks * _BLOCK - n, fill)]).reshape(blocks, _BLOCK) for x, fill in zip(m, (1.0, 0.0, 0.0, 1.0), strict=True)]
    whole = [x[:, 0] for x in padded]
    for t in range(1, _BLOCK):
        whole = _step(whole, [x[:, t] for x in padded])
    ends = scan(whole, start)
    p, q = (np.concatenate([[s], e[:-1]]) for s, e in zip(start, ends, strict=True))
    out = np.empty((2, blocks, _BLOCK))
    for t in range(_BLOCK):
        p, q = padded[0][:, t] * p + padded[1][:, t] * q, padded[2][:, t] * p + padded[3][:, t] * q
        total = p + q
        p, q = p / total, q / total
        out[0, :, t], out[1, :, t] = p, q
    return out[0].ravel()[:n], out[1].ravel()[:n]


@dataclass
class Chain:
    """Scores: ``transition[i, j]`` from label i to j, ``first[j]`` of a sequence's first label."""

    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def marginals(self, emission: np.ndarray, begins: np.ndarray, pairs: bool = False):  # noqa: ANN201
        """P(label 1) of every item; with ``pairs`` also the summed P(label i, next label j) over neighbours."""
        n = len(emission)
        if not n:
            return (np.zeros(0), np.zeros((2, 2))) if pairs else np.zeros(0)
        emission = np.clip(emission, -30, 30)
        e0, e1 = np.exp(np.minimum(-emission, 0)), np.exp(np.minimum(emission, 0))
        t, s = np.exp(self.transition - self.transition.max()), np.exp(self.first - self.first.max())
        ends = np.append(begins[1:], True)
        m = [np.where(begins, s[0], t[0, 0]) * e0, np.where(begins, s[0], t[1, 0]) * e0, np.where(begins, s[1], t[0, 1]) * e1, np.where(begins, s[1], t[1, 1]) * e1]
        f0, f1 = scan(m)
        n0, n1 = np.append(e0[1:], 1.0), np.append(e1[1:], 1.0)
        m = [np.where(ends, 1.0, t[0, 0] * n0)[::-1], np.where(ends, 1.0, t[0, 1] * n1)[::-1], np.where(ends, 1.0, t[1, 0] * n0)[::-1], np.where(ends, 1.0, t[1, 1] * n1)[::-1]]
        b0, b1 = (x[::-1] for x in scan(m))
        p0, p1 = f0 * b0, f1 * b1
        one = p1 / (p0 + p1)
        if not pairs:
            return one
        inner = ~ends[:-1]
        f, g, e = (f0[:-1], f1[:-1]), (b0[1:], b1[1:]), (e0[1:], e1[1:])
        joint = np.array([[f[i] * t[i, j] * e[j] * g[j] for j in (0, 1)] for i in (0, 1)])
        joint = joint / joint.sum((0, 1))
        return one, joint[:, :, inner].sum(2)


class Adam:
    """Steps for a list of arrays, changed in place."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.m, self.v = ([np.zeros_like(x) for x in arrays] for _ in range(2))

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        for x, g, m, v in zip(self.arrays, gradients, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-9)


def fit(chain: Chain, emission, gradient, arrays: list[np.ndarray], labels: np.ndarray, begins: np.ndarray, weights: np.ndarray, rounds: int, rate: float) -> None:  # noqa: ANN001
    """Maximise the mean likelihood of ``labels``: ``emission()`` gives the scores under ``arrays``, ``gradient(d)`` their gradients from d(loss)/d(emission)."""
    steps = Adam([*arrays, chain.transition, chain.first], rate)
    ends = np.append(begins[1:], True)[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:-1][~ends], labels[1:][~ends]), 1)
    starts = np.bincount(labels[begins], minlength=2)
    for _ in range(rounds):
        one, joint = chain.marginals(emission(), begins, pairs=True)
        total = len(labels)
        at_start = np.array([begins.sum() - one[begins].sum(), one[begins].sum()])
        steps.step([*gradient((one - labels) * weights / weights.sum()), (joint - seen) / total, (at_start - starts) / total])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (the last one the intercept) of a weighted logistic regression on standardised columns, and the standardisation."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):  # Newton steps, damped by the ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z / weight.sum() + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (weight * (p - y)) / weight.sum() + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale
