"""Small linear models trained with NumPy on the driver from bounded samples."""

from __future__ import annotations

import numpy as np


def linear_svm(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 200) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM (labels -1 and 1), classes weighted alike, by
    accelerated gradient steps. Returns weights and bias."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    w, b = np.zeros(x.shape[1], x.dtype), 0.0
    v, c, t = w.copy(), b, 1.0
    rate = 1.0 / (2 * float((weight * ((x * x).sum(axis=1) + 1)).sum()) + l2)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v + c)) * weight * y
        w1, b1 = v - rate * (l2 * v - 2 * (slack @ x)), c + rate * 2 * float(slack.sum())
        t1 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    return w, b


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, float)))
