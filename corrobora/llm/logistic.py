"""Logistic regression on a bounded sample, on the driver."""

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge=1.0, steps=30) -> np.ndarray:
    """Coefficients of the columns of ``x`` and, last, the constant: Newton steps on the ridge-penalised likelihood."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.ones(len(x)) if weight is None else weight
    beta = np.zeros(x.shape[1])
    penalty = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(steps):
        p = sigmoid(x @ beta)
        gradient = x.T @ (weight * (p - y)) + penalty * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(curve + 1e-9 * np.eye(len(beta)), gradient)
        size = np.abs(move).max()
        beta -= move * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-7:
            break
    return beta


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logit(p):
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def spread_of(x: np.ndarray):
    """(mean, deviation) of the columns, for standardising."""
    return x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
