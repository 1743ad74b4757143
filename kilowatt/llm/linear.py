"""Hashed sparse logistic regression: FTRL-proximal over flat feature arrays."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """FTRL-proximal logistic regression, updated a small batch of rows at a time.

    Every coordinate has a rate of its own, from the sum of its squared
    gradients; L1 keeps a coordinate at exactly zero until its summed gradient
    is larger than ``l1``. The last coordinate is the bias, without L1.
    """

    def __init__(self, size: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.size, self.alpha, self.beta, self.l1, self.l2 = size, alpha, beta, l1, l2
        self.z = np.zeros(size + 1)
        self.n = np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == self.size, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def update(self, row: np.ndarray, at: np.ndarray, value: np.ndarray, label: np.ndarray) -> None:
        """A batch: value of coordinate ``at`` in ``row``, and a label (0 to 1) for each row."""
        rows = len(label)
        row = np.concatenate([row, np.arange(rows)])
        value = np.concatenate([value, np.ones(rows)])
        used, place = np.unique(np.concatenate([at, np.full(rows, self.size)]), return_inverse=True)
        w = self.weights(used)
        margin = np.bincount(row, w[place] * value, minlength=rows)
        error = sigmoid(margin) - label
        each = error[row] * value
        g = np.bincount(place, each, minlength=len(used))
        square = np.bincount(place, each * each, minlength=len(used))
        old = self.n[used]
        sigma = (np.sqrt(old + square) - np.sqrt(old)) / self.alpha
        self.z[used] += g - sigma * w
        self.n[used] = old + square

    def fit(self, ends: np.ndarray, at: np.ndarray, value: np.ndarray, label: np.ndarray, epochs: int, batch: int = 32) -> None:
        """Rows in the given order, ``epochs`` times: row i has the features ends[i]:ends[i + 1]."""
        for _ in range(epochs):
            for i in range(0, len(label), batch):
                stop = min(len(label), i + batch)
                a, b = int(ends[i]), int(ends[stop])
                row = np.repeat(np.arange(stop - i), np.diff(ends[i:stop + 1]))
                self.update(row, at[a:b], value[a:b], label[i:stop])

    def compact(self) -> tuple[np.ndarray, np.ndarray, float]:
        """(coordinates, weights, bias): those that are not zero."""
        w = self.weights(np.arange(self.size + 1))
        at = np.flatnonzero(w[:-1])
        return at.astype(np.int32), w[at].astype(np.float32), float(w[-1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))
