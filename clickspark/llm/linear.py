"""A small logistic regression on a bounded number of feature rows, for the operators that end in one."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps with a ridge on standardised features. Without both labels, the prior alone."""
    n, k = x.shape
    if not n:
        return np.zeros(k), 0.0
    mean, std = x.mean(0), x.std(0)
    std = np.where(std > 0, std, 1.0)
    z = np.column_stack([(x - mean) / std, np.ones(n)])
    prior = (y.sum() + 0.5) / (n + 1.0)
    w = np.append(np.zeros(k), np.log(prior / (1 - prior)))
    if 0 < y.sum() < n:
        penalty = np.diag(np.append(np.full(k, ridge), 1e-6))
        for _ in range(rounds):
            p = sigmoid(z @ w)
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
            step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            w -= step
            if np.abs(step).max() < 1e-8:
                break
    weights = w[:-1] / std
    return weights, float(w[-1] - weights @ mean)
