"""Closed-form profiles as column expressions of a position."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(terms):
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def gaussian(x: list[Column], amplitude: float, sigma: list[float], center: list[float]) -> Column:
    """``A exp(-sum(((x - c) / s)^2))``, without the factor one half."""
    parts = [((p - F.lit(c)) / F.lit(s)) for p, s, c in zip(x, sigma, center, strict=True)]
    return F.lit(amplitude) * F.exp(-_sum([p * p for p in parts]))


def tanh(x: list[Column], amplitude: float, sigma: float, center: float) -> Column:
    """``A tanh((|x| - c) / s)``."""
    return F.lit(amplitude) * F.tanh((F.sqrt(_sum([p * p for p in x])) - F.lit(center)) / F.lit(sigma))


def seed(rho: Column, z: Column, amplitude: float, sigma_rho: float, sigma_z: float) -> Column:
    """``rho A exp(-rho^2 / sr^2 - z^2 / sz^2)``."""
    return rho * F.lit(amplitude) * F.exp(-(rho * rho) / F.lit(sigma_rho**2) - (z * z) / F.lit(sigma_z**2))


def smooth(strength: float, power: float, r: Column) -> Column:
    """``1 - tanh(s / r^n)``; 1 without strength, 0 at the origin."""
    if abs(strength) < 1e-15:
        return F.lit(1.0)
    return F.when(r == 0, F.lit(0.0)).otherwise(1.0 - F.tanh(F.lit(strength) / F.pow(r, F.lit(power))))


def gauss_gradient(r: Column, amplitude: float, sigma: float, center: float = 0.0) -> Column:
    """Radial derivative of ``A exp(-((r - c) / s)^2)``."""
    u = (r - F.lit(center)) / F.lit(sigma)
    return F.lit(-2.0 * amplitude / sigma) * u * F.exp(-(u * u))


def tanh_gradient(r: Column, amplitude: float, sigma: float, center: float) -> Column:
    """Radial derivative of ``A tanh((r - c) / s)``."""
    t = F.tanh((r - F.lit(center)) / F.lit(sigma))
    return F.lit(amplitude / sigma) * (1.0 - t * t)


def harmonic_20(*_: Column) -> Column:
    """The profile of degree 2 and order 0, which is zero everywhere."""
    return F.lit(0.0)


def isotropic_black_hole(radius: Column, mass: float) -> Column:
    """Conformal factor ``1 + m / 2r``, with the radius not below m / 10."""
    return 1.0 + F.lit(mass / 2) / F.greatest(radius, F.lit(mass / 10))


def polar(radius: Column, theta: Column) -> tuple[Column, Column]:
    """(r, z) of a curve around the origin; neither is negative."""
    return F.greatest(radius * F.cos(theta), F.lit(0.0)), F.greatest(radius * F.sin(theta), F.lit(0.0))


def conformal_metric(rho: Column, psi: Column, seed: Column) -> dict[str, Column]:
    """Metric, seed, lapse and shift of initial data at rest, from the conformal factor and the seed."""
    scale = F.pow(psi, F.lit(4.0)) * F.exp(2.0 * rho * seed)
    return {"grr": scale, "grz": F.lit(0.0), "gzz": scale, "s": -seed, "lapse": F.lit(1.0), "shift_r": F.lit(0.0), "shift_z": F.lit(0.0)}


def black_hole_metric(rho: Column, z: Column, mass: float) -> dict[str, Column]:
    """An isotropic black hole; the lapse is -1 far away and passes 0 at the horizon."""
    radius = F.greatest(F.sqrt(rho * rho + z * z), F.lit(mass / 10))
    scale = F.pow(isotropic_black_hole(radius, mass), F.lit(4.0))
    return {"grr": scale, "grz": F.lit(0.0), "gzz": scale, "s": F.lit(0.0), "lapse": (mass - 2.0 * radius) / (mass + 2.0 * radius)}


def conformal_residual(rho: Column, psi: dict[str, Column], seed: dict[str, Column], fields: list[tuple[dict[str, Column], float]]) -> Column:
    """What is left of the Hamiltonian constraint at rest; ``psi``, ``seed`` and fields hold "v", "r", "z", "rr", "zz".

    Each field is given with its mass. On the axis ``psi_r / rho`` is ``psi_rr``.
    """
    flat = psi["rr"] + psi["zz"] + F.when(F.abs(rho) <= 10e-10, psi["rr"]).otherwise(psi["r"] / rho)
    bending = rho * (seed["rr"] + seed["zz"]) + 2.0 * seed["r"]
    density = F.lit(0.0)
    for u, mass in fields:
        well = F.exp(2.0 * rho * seed["v"]) * F.pow(psi["v"], F.lit(4.0)) * F.lit(mass * mass) * u["v"] * u["v"]
        density = density + (u["r"] * u["r"] + u["z"] * u["z"] + well) / 2.0
    return flat + psi["v"] / 4.0 * (bending + F.lit(8.0 * math.pi) * density)
