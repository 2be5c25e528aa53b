"""Logistic regression on sparse rows; small helper for the trained scorers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Sparse:
    """Rows of (column, value) pairs, flattened."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    rows: int
    columns: int

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], minlength=self.rows)

    def transposed_times(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], minlength=self.columns)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(
    x: Sparse, dense: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 300
) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the sparse columns, of the dense columns, and the intercept.

    Accelerated gradient descent on mean log loss with soft targets in [0, 1];
    deterministic.  The step size follows from the largest row norm.
    """
    n = max(x.rows, 1)
    weight = np.ones(x.rows) if weight is None else weight
    total = max(weight.sum(), 1e-12)
    k = dense.shape[1]
    norms = np.bincount(x.row, x.value**2, minlength=n)[: x.rows] + (dense**2).sum(1) + 1
    rate = 1 / (0.25 * max(norms.max(initial=1.0), 1e-9) + l2)
    w, u, b = np.zeros(x.columns), np.zeros(k), 0.0
    yw, yu, yb, t = w, u, b, 1.0
    base = float(np.clip((weight @ target) / total, 1e-3, 1 - 1e-3)) if x.rows else 0.5
    b = yb = float(np.log(base / (1 - base)))
    for _ in range(steps if x.rows else 0):
        r = weight * (sigmoid(x.times(yw) + dense @ yu + yb) - target) / total
        nw = yw - rate * (x.transposed_times(r) + l2 * yw)
        nu = yu - rate * (dense.T @ r + l2 * yu)
        nb = yb - rate * r.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        m = (t - 1) / nt
        yw, yu, yb = nw + m * (nw - w), nu + m * (nu - u), nb + m * (nb - b)
        w, u, b, t = nw, nu, nb, nt
    return w, u, float(b)
