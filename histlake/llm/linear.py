"""A linear hinge-loss model by dual coordinate descent, and the calibration of its margins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def dual_coordinate_descent(
    rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, costs: np.ndarray, n_features: int, *, epochs: int = 12, seed: int = 1
) -> np.ndarray:
    """Weights (the last is the bias) minimising ``|w|^2 / 2 + sum_i costs_i * max(0, 1 - y_i w x_i)``.

    ``rows``: per example the indices and values of its features; y: -1 or 1. One dual
    variable is changed at a time, to its minimum within [0, cost].
    """
    w = np.zeros(n_features + 1)
    alpha = np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            idx, val = rows[i]
            gradient = y[i] * (w[idx] @ val + w[-1]) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), costs[i])
            if (step := new - alpha[i]) != 0.0:
                alpha[i] = new
                w[idx] += step * y[i] * val
                w[-1] += step * y[i]
                worst = max(worst, abs(step))
        if worst < 1e-4:
            break
    return w


@dataclass(frozen=True)
class Sigmoid:
    """score = 1 / (1 + exp(-(slope * margin + shift)))."""

    slope: float
    shift: float

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * np.asarray(margin, dtype=float) + self.shift, -35, 35)
        return 1.0 / (1.0 + np.exp(-z))


def fit_sigmoid(margin: np.ndarray, positive: np.ndarray, weight: np.ndarray, steps: int = 60) -> Sigmoid:
    """Weighted logistic fit of held-out margins, with targets drawn in a little from 0 and 1 (Platt)."""
    n1, n0 = float(weight[positive].sum()), float(weight[~positive].sum())
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = float(np.std(margin)) or 1.0
    x = np.stack([margin / scale, np.ones_like(margin)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -35, 35)))
        gradient = x.T @ (weight * (p - target)) + np.array([1e-3, 0.0]) * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2) * max(1.0, float(weight.sum()))
        step = np.linalg.solve(hessian, gradient)
        size = float(np.abs(step).max())
        beta = beta - step * min(1.0, 2.0 / size if size else 1.0)
        if size < 1e-8:
            break
    return Sigmoid(max(0.0, float(beta[0])) / scale, float(beta[1]))
