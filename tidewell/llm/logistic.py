"""Maximum-entropy (logistic) models of hashed features, trained on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np


def train(places: list, y: np.ndarray, size: int, epochs: int = 6, rate: float = 0.3, penalty: float = 1e-5, seed: int = 7) -> np.ndarray:
    """Weights (size of them) of the model of features at places and chances y, by stochastic gradients with adaptive rates."""
    weights, squares = np.zeros(size), np.full(size, 1e-6)
    if not len(y):
        return weights
    sizes = np.array([len(p) for p in places])
    flat = np.concatenate([np.asarray(p) for p in places])
    edges = np.concatenate([[0], np.cumsum(sizes)])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(y)), max(1, len(y) // 256)):
            at = np.concatenate([flat[edges[i] : edges[i + 1]] for i in part])
            row = np.repeat(np.arange(len(part)), sizes[part])
            score = np.bincount(row, weights[at], len(part))
            wrong = y[part] - 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            places_, inverse = np.unique(at, return_inverse=True)
            slope = np.bincount(inverse, wrong[row]) - penalty * weights[places_] * len(part)
            squares[places_] += slope**2
            weights[places_] += rate * slope / np.sqrt(squares[places_])
    return weights
