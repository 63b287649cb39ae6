"""Apparent horizons: closed curves around the origin on which outgoing light does not expand.

A search relaxes ``radius(theta)`` over a quarter turn; a batch of searches is one array, so many run in one kernel.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ..functions import axisymmetric as A
from ..functions import weights as K

#: Geometry, extrinsic curvature and y at (r, z); not a number where there is none.
State = Callable[[np.ndarray, np.ndarray], tuple[A.Plane, dict, A.Jet]]


@dataclass(frozen=True)
class Search:
    """``start`` is the first radius; below ``least`` a curve counts as shrunk to nothing."""

    start: float = 3.0
    least: float = 0.05
    cells: int = 16
    dampening: float = 2.0
    cfl: float = 0.5
    tolerance: float = 1e-8
    most: int = 4000


def derivatives(u: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative along the last axis; both ends mirror."""
    x = np.concatenate([u[..., 2:0:-1], u, u[..., -2:-4:-1]], axis=-1)
    n = u.shape[-1]
    out = []
    for kernel in (K.derivative(4), K.derivative(4, 2)):
        out.append(sum(w * x[..., 2 + o : 2 + o + n] for o, w in kernel.interior.items()) * kernel.scale(h))
    return out[0], out[1]


def find(state: State, count: int, search: Search = Search()) -> dict[str, np.ndarray]:
    """Status, mean radius and steps of ``count`` searches; ``state`` sees arrays of shape (count, cells + 1).

    Each search stops by itself: "converged", "converged_to_zero", "not_contained" where the state ends,
    "diverged", or "max_steps".
    """
    theta = np.linspace(0.0, np.pi / 2, search.cells + 1)[None, :]
    h, dt, eta = theta[0, 1], search.cfl * theta[0, 1], search.dampening

    def pull(radius):
        slope, bend = derivatives(radius, h)
        r, z = A.polar(radius, theta)
        plane, k, y = state(r, z)
        return -radius * radius * A.null_expansion(plane, k, y, theta, radius, slope, bend)

    u = np.full((count, search.cells + 1), search.start)
    v = eta * u
    status, steps = np.full(count, "max_steps", dtype=object), np.full(count, search.most)
    found, live = u.copy(), np.ones(count, bool)

    def settle(which, name, step):
        nonlocal live
        which = which & live
        status[which], steps[which], found[which] = name, step, u[which]
        live = live & ~which

    with np.errstate(all="ignore"):
        for step in range(search.most):
            residual = pull(u)
            norm = np.sqrt((residual**2).mean(axis=1))
            settle(norm <= search.tolerance, "converged", step)
            settle(u.min(axis=1) < search.least, "converged_to_zero", step)
            settle(np.abs(u).max(axis=1) > 1e60, "diverged", step)
            settle(~np.isfinite(norm), "not_contained", step)
            if not live.any():
                break
            du, dv, x, w = 0.0, 0.0, u, v
            for c, part in ((0.5, 1 / 6), (0.5, 1 / 3), (1.0, 1 / 3), (0.0, 1 / 6)):
                a, b = w - eta * x, pull(x)
                du, dv = du + part * a, dv + part * b
                x, w = u + c * dt * a, v + c * dt * b
            u, v = np.where(live[:, None], u + dt * du, u), np.where(live[:, None], v + dt * dv, v)
    found[live] = u[live]
    return {"status": status, "radius": found.mean(axis=1), "steps": steps}


def searched(params: DataFrame, state_of: Callable[[np.ndarray], State], search: Search = Search(), batch: int = 64) -> DataFrame:
    """A row of results for each value of ``param``; ``state_of`` gets a column of them."""
    schema = "param double, status string, radius double, steps long"

    def kernel(frames):
        import pandas as pd

        for f in frames:
            values = f["param"].dropna().to_numpy()
            for at in range(0, len(values), batch):
                part = values[at : at + batch]
                yield pd.DataFrame({"param": part, **find(state_of(part[:, None]), len(part), search)})

    return params.select("param").mapInPandas(kernel, schema)
