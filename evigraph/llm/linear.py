"""Linear models over sparse indicator features, fitted on bounded samples on the driver."""

from __future__ import annotations

import numpy as np


class Sparse:
    """Rows of feature numbers: those of row i are index[start[i]:start[i + 1]]."""

    def __init__(self, rows: list[np.ndarray]):
        small = all(len(r) == 0 or r.max() < 1 << 31 for r in rows)
        self.start = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.index = np.concatenate(rows).astype(np.int32 if small else np.int64) if len(rows) else np.empty(0, np.int64)
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(self.start))

    def __len__(self) -> int:
        return len(self.start) - 1

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.index], len(self))

    def counts(self, size: int, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, weight[self.row], size)


def log_count_ratios(x: Sparse, size: int, positive: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log of the normalised class counts of each indicator; positive: 0..1 for each row."""
    p, q = smooth + x.counts(size, positive), smooth + x.counts(size, 1 - positive)
    return np.log((p / p.sum()) / (q / q.sum()))


def hinge_dual(x: Sparse, scale: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss by dual coordinate descent; rows are scaled to length 1, the last weight is the bias.

    y: -1 or 1; cost: upper bound of each row's dual variable.
    """
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(len(scale)), 0.0
    start = x.start.tolist()
    norm = np.array([max(1e-9, float(np.sqrt((scale[x.index[a:b]] ** 2).sum()))) for a, b in zip(start, start[1:], strict=False)])
    alpha = np.zeros(len(y))
    for _ in range(rounds):
        for k in rng.permutation(len(y)):
            i = x.index[start[k] : start[k + 1]]
            v = scale[i] / norm[k]
            g = y[k] * (w[i] @ v + bias) - 1
            new = min(max(alpha[k] - g / 2.0, 0.0), cost[k])  # the row's square length is 1, its bias adds 1
            step = (new - alpha[k]) * y[k]
            if step:
                alpha[k] = new
                w[i] += step * v
                bias += step
    return w, bias


def logistic(x: Sparse, scale: np.ndarray, target: np.ndarray, decay: float = 1e-4, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets over length-normalised rows, by accelerated gradient steps."""
    squares = np.bincount(x.row, scale[x.index] ** 2, len(x))
    norm = 1 / np.sqrt(np.maximum(squares, 1e-9))
    w, bias, v, vb = np.zeros(len(scale)), 0.0, np.zeros(len(scale)), 0.0
    rate = 8.0 / 2
    for k in range(rounds):
        m = k / (k + 3)
        wa, ba = w + m * v, bias + m * vb
        z = x.dot(wa * scale) * norm + ba
        d = (1 / (1 + np.exp(-z)) - target) / len(x)
        gw = np.bincount(x.index, (d * norm)[x.row], len(scale)) * scale + decay * wa
        nw, nb = wa - rate * gw, ba - rate * d.sum()
        v, vb, w, bias = nw - w, nb - bias, nw, nb
    return w, bias


def sigmoid_fit(z: np.ndarray, target: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a z + b))) by Newton steps, with slightly softened targets."""
    n1, n0 = target.sum(), (1 - target).sum()
    t = np.where(target > 0.5, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, h = p - t, np.maximum(p * (1 - p), 1e-9)
        ga, gb = (g * z).sum() + 1e-3 * a, g.sum()
        haa, hab, hbb = (h * z * z).sum() + 1e-3, (h * z).sum(), h.sum() + 1e-9
        det = haa * hbb - hab * hab
        sa, sb = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        most = max(1.0, abs(sa), abs(sb))
        a, b = a - sa / most, b - sb / most
    return float(a), float(b)
