"""Least-squares weights on reference elements."""

from __future__ import annotations

from itertools import product

import numpy as np


def uniform_points(n: int, dims: int = 1) -> np.ndarray:
    """``n`` points on [-1, 1] for each axis, axis 0 fastest."""
    x = np.linspace(-1, 1, n)
    return np.array([p[::-1] for p in product(x, repeat=dims)])


def monomials(order: int, points: np.ndarray, derivative: tuple[int, ...] | None = None) -> np.ndarray:
    """Tensor monomials up to ``order`` on each axis, or their derivatives, at points: a row for each point."""
    points = np.atleast_2d(points)
    dims = points.shape[1]
    derivative = derivative or (0,) * dims
    out = []
    for powers in product(range(order + 1), repeat=dims):
        col = np.ones(len(points))
        for a, (m, d) in enumerate(zip(powers[::-1], derivative, strict=True)):
            factor = float(np.prod([m - k for k in range(d)])) if d else 1.0
            col = col * (factor * points[:, a] ** (m - d) if m >= d else 0.0)
        out.append(col)
    return np.array(out).T


def operator_weights(support: np.ndarray, order: int, at: np.ndarray, derivative: tuple[int, ...] | None = None) -> np.ndarray:
    """Minimum-norm weights, a row for each target, that are exact on the monomials."""
    v, rhs = monomials(order, support), monomials(order, at, derivative)
    return rhs @ np.linalg.pinv(v)


def interpolation_weights(n: int, order: int, x: float) -> np.ndarray:
    """Weights on ``n`` uniform points for the value at ``x``."""
    return operator_weights(uniform_points(n), order, np.array([[x]]))[0]


def point_classes(width: int, dims: int = 2, buffer: int = 0) -> dict[str, list[tuple[int, ...]]]:
    """Points of a refined element by parity: nodal (all even), diagonal (all odd), those of them inside a buffer, detail (any odd)."""
    every = [p[::-1] for p in product(range(2 * width + 1), repeat=dims)]
    odd = [p for p in every if all(k % 2 for k in p)]
    return {
        "nodal": [p for p in every if not any(k % 2 for k in p)], "diagonal": odd, "diagonal_int": [p for p in odd if all(buffer <= k <= 2 * width - buffer for k in p)],
        "detail": [p for p in every if any(k % 2 for k in p)],
    }
