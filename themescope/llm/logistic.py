"""A small logistic regression for bounded samples on the driver."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Logistic(NamedTuple):
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0,
                 steps: int = 40) -> Logistic:
    """Newton's method with a ridge penalty.  With one class only, or no rows, a constant: the share of
    ones with half a row added to each class."""
    weight = np.ones(len(y)) if weight is None else weight
    width = x.shape[1] if x.ndim == 2 else 0
    share = (float(y @ weight) + 0.5) / (float(weight.sum()) + 1.0)
    if len(y) == 0 or y.min() == y.max():
        return Logistic(np.zeros(width), float(np.log(share / (1 - share))), np.zeros(width), np.ones(width))
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    penalty = np.full(width + 1, ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(width + 1)
    beta[-1] = np.log(share / (1 - share))
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ beta, -40, 40)))
        gradient = z.T @ (weight * (p - y)) + penalty * beta
        curve = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        beta = beta - step
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(beta[:-1], float(beta[-1]), mean, scale)
