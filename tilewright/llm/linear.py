"""A sparse logistic model in numpy, for samples of bounded size."""

from __future__ import annotations

import numpy as np


def hashed(name: str, bits: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(name) & ((1 << bits) - 1)


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, l2: float = 1e-4, steps: int = 400, rate: float = 0.1, pairs=None, pair_weight: float = 0.0, weight: np.ndarray | None = None):
    """Weights and bias by Adam on the whole sample. y may be soft labels.

    pairs: (rows, cols, values, weight by row) of feature differences whose scores should be 0; their
    weighted mean square is added, times pair_weight. weight: how often each row counts (once if None).
    """
    n = len(y)
    weight = np.ones(n) if weight is None else weight
    mean = (weight * y).sum() / weight.sum() if n else 0.0
    w, b = np.zeros(width), float(np.log((mean + 1e-3) / (1 - mean + 1e-3))) if n else 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1) if n else ():
        p = sigmoid(np.bincount(rows, values * w[cols], n) + b)
        d = weight * (p - y) / weight.sum()
        g = np.append(np.bincount(cols, values * d[rows], width) + l2 * w, d.sum())
        if pairs is not None and len(pairs[3]):
            pr, pc, pv, k = pairs
            gap = k * np.bincount(pr, pv * w[pc], len(k)) / k.sum()
            g[:-1] += pair_weight * 2 * np.bincount(pc, pv * gap[pr], width)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b
