"""Sparse multinomial logistic regression, trained with follow-the-regularised-leader."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class SoftmaxFTRL:
    """Per-coordinate FTRL-proximal with elastic-net penalties ``l1`` and ``l2``."""

    dim: int
    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.5
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self):
        self.z = np.zeros((self.dim, self.classes))
        self.n = np.zeros((self.dim, self.classes))

    def rows(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, at: np.ndarray, x: np.ndarray, label: int, weight: float = 1.0) -> None:
        w = self.rows(at)
        error = softmax(x @ w)
        error[label] -= 1.0
        g = weight * np.outer(x, error)
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g

    def fit(self, examples, epochs: int = 3, seed: int = 7) -> np.ndarray:
        """``examples``: (feature ids, values, class, weight). Returns the dense weights."""
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in order.permutation(len(examples)):
                self.step(*examples[i])
        return self.rows(np.arange(self.dim)).astype(np.float32)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on held-back rows."""
    if len(labels) == 0:
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high = np.log(0.05), np.log(20.0)
    ratio = (np.sqrt(5.0) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) <= loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))
