"""A linear hinge-loss model fitted by dual coordinate descent (numpy only).

The fit is for a bounded sample of rows; callers run it inside one Spark task.
"""

from __future__ import annotations

import numpy as np


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, dim: int, alpha: float = 1.0,
                    min_rows: int = 1) -> np.ndarray:
    """log of (smoothed share of each indicator in class +1 / in class -1);
    0 for indicators that fewer than `min_rows` rows carry."""
    pos = np.zeros(dim)
    neg = np.zeros(dim)
    for f, label in zip(rows, y, strict=True):
        (pos if label > 0 else neg)[f] += 1
    seen = pos + neg
    n_pos, n_neg = max(1, int((y > 0).sum())), max(1, int((y < 0).sum()))
    r = np.log((pos + alpha) / (n_pos + 2 * alpha)) - np.log((neg + alpha) / (n_neg + 2 * alpha))
    r[seen < max(1, min_rows)] = 0.0
    return r


def fit_hinge(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, dim: int,
              c: float = 1.0, epochs: int = 12, seed: int = 0, tol: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + sum c_i * hinge(y_i (w.x_i + b)), each
    class with the same total cost; one dual variable is solved at a time."""
    n = len(rows)
    w, b = np.zeros(dim), 0.0
    share = {s: n / (2.0 * max(1, int((y == s).sum()))) for s in (-1, 1)}
    cost = np.array([c * share[int(s)] for s in y])
    q = np.array([float(v @ v) + 1.0 for v in values])
    alpha = np.zeros(n)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(n):
            f, v, s = rows[i], values[i], float(y[i])
            g = s * (float(w[f] @ v) + b) - 1.0
            new = min(max(alpha[i] - g / q[i], 0.0), cost[i])
            step = (new - alpha[i]) * s
            if step:
                worst = max(worst, abs(step))
                alpha[i] = new
                w[f] += step * v
                b += step
        if worst < tol:
            break
    return w, b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))
