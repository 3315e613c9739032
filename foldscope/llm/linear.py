"""Logistic regression on small dense matrices, fitted on the driver from bounded samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


@dataclass
class Logistic:
    """Weights on standardised columns; the last is the constant."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.score(x))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 12) -> Logistic:
    """Newton's method with an L2 penalty (not on the constant). One class alone gives a constant near its rate."""
    mean, scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    w = np.zeros(z.shape[1])
    w[-1] = logit(rate)
    if len(np.unique(y)) < 2:
        return Logistic(mean, scale, w)
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        size = np.abs(step).max()
        w += step * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-5:
            break
    return Logistic(mean, scale, w)


def folds(keys: np.ndarray, n: int) -> np.ndarray:
    """Fold of each row by its place among the sorted keys, so that reruns agree."""
    out = np.empty(len(keys), int)
    out[np.argsort(keys, kind="stable")] = np.arange(len(keys)) % n
    return out


def out_of_fold(x: np.ndarray, y: np.ndarray, fold: np.ndarray, n: int, penalty: float = 1.0) -> np.ndarray:
    """Each row's probability from the model of the other folds."""
    p = np.zeros(len(y))
    for k in range(n):
        if (fold == k).any():
            p[fold == k] = fit(x[fold != k], y[fold != k], penalty).predict(x[fold == k])
    return p


def calibrated(score: np.ndarray, y: np.ndarray) -> Logistic:
    """Platt scaling: a logistic model of held-out scores."""
    return fit(score.reshape(-1, 1), y, 1e-3)
