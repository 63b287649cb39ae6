"""Hyperbolic relaxation of elliptic equations: ``u_t = v - eta u``, ``v_t = L(u)``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Relaxation:
    dampening: float = 0.4
    cfl: float = 0.1
    tolerance: float = 1e-6
    most: int = 10_000


class RelaxationError(RuntimeError):
    pass


def relax(u: np.ndarray, operator: Callable[[np.ndarray], np.ndarray], spacing: float, settings: Relaxation = Relaxation(), watch: Callable[[int, np.ndarray, float], None] | None = None) -> tuple[np.ndarray, int]:
    """Runs to a residual below the tolerance, in the root mean square; returns the solution and the steps.

    One elliptic problem is one kernel: it fits a task, and many problems run side by side in
    ``mapInPandas``. ``watch`` sees every step and may stop it by raising.
    """
    h, eta = settings.cfl * spacing, settings.dampening
    v = eta * u
    for step in range(settings.most):
        r = operator(u)
        norm = float(np.sqrt(np.mean(r**2)))
        if not np.isfinite(norm) or norm > 1e60:
            raise RelaxationError(f"diverged after {step} steps")
        if watch:
            watch(step, u, norm)
        if norm <= settings.tolerance:
            return u, step
        du, dv, x, y = 0.0, 0.0, u, v
        for c, w in ((0.5, 1 / 6), (0.5, 1 / 3), (1.0, 1 / 3), (0.0, 1 / 6)):
            a, b = y - eta * x, operator(x)
            du, dv = du + w * a, dv + w * b
            x, y = u + c * h * a, v + c * h * b
        u, v = u + h * du, v + h * dv
    raise RelaxationError(f"no solution after {settings.most} steps")
