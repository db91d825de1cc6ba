"""Sparse logistic regression with follow-the-regularised-leader (proximal) updates, in numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def sigmoid(x: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Weights of size hashed features and a bias (the last). l1 keeps weights of chance features at zero."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def at(self, index: np.ndarray) -> np.ndarray:
        z = self.z[index]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[index])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def bias(self) -> float:
        return float(-self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha))

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(self.at(index) @ value) + self.bias()

    def step(self, index: np.ndarray, gradient: np.ndarray, bias_gradient: float) -> None:
        """One update with the loss's gradient in these features."""
        w, n = self.at(index), self.n[index]
        self.z[index] += gradient - (np.sqrt(n + gradient**2) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + gradient**2
        w, n = self.bias(), self.n[-1]
        self.z[-1] += bias_gradient - (np.sqrt(n + bias_gradient**2) - np.sqrt(n)) / self.alpha * w
        self.n[-1] = n + bias_gradient**2

    def fit(self, rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int) -> None:
        """rows: (feature indices without repeats, values). The order of each round is fixed."""
        for r in range(rounds):
            for i in np.random.Generator(np.random.PCG64(r)).permutation(len(rows)):
                index, value = rows[i]
                g = float(sigmoid(self.margin(index, value))) - labels[i]
                self.step(index, g * value, g)

    def weights(self) -> tuple[np.ndarray, float]:
        return self.at(np.arange(len(self.z) - 1)).astype(np.float32), self.bias()
