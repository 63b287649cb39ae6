"""Exact solutions of the axisymmetric equations, searches for horizons, settings, and keys of doubles."""

import copy

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.functions import axisymmetric as A
from gridlark.functions import numbers as N
from gridlark.operators import horizon as H
from gridlark.plans import axisymmetric as Q
from gridlark.sources import settings

R = np.concatenate([np.random.default_rng(1).uniform(0.3, 2, 20), np.zeros(5)])
Z = np.random.default_rng(2).uniform(0.6, 2, 25)


def jet(f):
    return A.jet_of(f, R, Z)


def none(r, z):
    return np.zeros_like(r + z)


def still(out):
    return Q.largest(*[out[n] for n in ("g", "seed", "k", "y", "theta", "z", "hamiltonian", "momentum")]).max()


def isotropic(mass=1.0):
    scale = lambda r, z: (1 + mass / 2 / np.hypot(r, z)) ** 4
    plane = A.Plane(R, A.pair(jet(scale), jet(none), jet(scale)), jet(none))
    k, (theta, zed) = A.pair(jet(none), jet(none), jet(none)), A.at_rest(R, Z)
    lapse = jet(lambda r, z: (1 - mass / 2 / np.hypot(r, z)) / (1 + mass / 2 / np.hypot(r, z)))
    return A.Slice(plane, k, theta, theta, zed, lapse, zed)


def test_black_hole_at_rest():
    x = isotropic()
    for gauge in A.GAUGES:
        assert still(A.rates(x, gauge)) < 1e-8
    assert np.abs(A.rates(x, "k_driver_zero_shift")["lapse"]).max() < 1e-8
    d, zero = np.hypot(R, Z), np.zeros_like(R)
    psi = 1 + 0.5 / d
    got = A.null_expansion(x.plane, x.k, x.y, np.arctan2(Z, R), d, zero, zero)
    assert np.abs(got - (2 / d - 2 / (d * d * psi)) / psi**2).max() < 1e-8
    with pytest.raises(ValueError):
        A.rates(x, "none")


def test_slices_that_fall_in_bent_coordinates():
    """Flat slices seen in coordinates that bend and shear: every field is used, and nothing moves."""
    c1, c2, mass = 0.2, 0.15, 1.0
    to = lambda r, z: (r * (1 + c1 * z * z), z + c2 * r * r * z + 0.1 * z * z)
    er = lambda r, z: (1 + c1 * z * z, 2 * c2 * r * z)
    ez = lambda r, z: (2 * c1 * r * z, 1 + c2 * r * r + 0.2 * z)
    ratio = lambda p, q: np.sqrt(2 * mass) * (p * p + q * q) ** -0.75

    def curvature(p, q):
        b, f = ratio(p, q), -1.5 * ratio(p, q) / (p * p + q * q)
        return ((b + p * p * f, p * q * f), (p * q * f, b + q * q * f))

    def dot(a, b):
        return lambda r, z: sum(x * y for x, y in zip(a(r, z), b(r, z), strict=True))

    def bent(a, b):
        return lambda r, z: sum(a(r, z)[i] * curvature(*to(r, z))[i][j] * b(r, z)[j] for i in range(2) for j in range(2))

    def inside(f):  # a quotient by r, from beside the axis
        return lambda r, z: f(np.where(np.abs(r) < 1e-9, 1e-5, r), z)

    seed = inside(lambda r, z: np.log((1 + c1 * z * z) / np.sqrt(dot(er, er)(r, z))) / r)
    y = inside(lambda r, z: (ratio(*to(r, z)) - bent(er, er)(r, z) / dot(er, er)(r, z)) / r)

    def shift(i):
        def f(r, z):
            (a, b), (c, d), (p, q) = er(r, z), ez(r, z), to(r, z)
            s = ratio(p, q) / (a * d - b * c)
            return (d * p - c * q) * s if i == 0 else (a * q - b * p) * s

        return f

    plane = A.Plane(R, A.pair(jet(dot(er, er)), jet(dot(er, ez)), jet(dot(ez, ez))), jet(seed))
    theta, zed = A.at_rest(R, Z)
    x = A.Slice(plane, A.pair(jet(bent(er, er)), jet(bent(er, ez)), jet(bent(ez, ez))), jet(y), theta, zed, jet(lambda r, z: 1 + none(r, z)), {(0,): jet(shift(0)), (1,): jet(shift(1))})
    assert still(A.rates(x)) < 2e-4
    off = np.abs(R) > 0
    assert Q.largest(*[{i: v[off] for i, v in A.rates(x)[n].items()} for n in ("g", "k", "z")]).max() < 1e-7


def test_searches_end_by_their_outcome():
    def state(r, z):
        plane, k, y, _, _ = A.falling_slices(r, z, np.array([[0.5], [0.8]]))
        return plane, k, y

    out = H.find(state, 2)
    assert out["status"].tolist() == ["converged"] * 2 and np.allclose(out["radius"], [1.0, 1.6], atol=1e-6)
    assert H.find(state, 2, H.Search(most=3))["status"].tolist() == ["max_steps"] * 2

    def empty(r, z):
        theta, _ = A.at_rest(r, z)
        return A.Plane(r, A.pair(A.Jet(1 + 0 * r), theta, A.Jet(1 + 0 * r)), theta), A.pair(theta, theta, theta), theta

    assert H.find(empty, 1)["status"].tolist() == ["converged_to_zero"]

    def small(r, z):
        plane, k, y = empty(r, z)
        return plane, k, A.Jet(np.where(np.hypot(r, z) > 2, np.nan, 0.0))

    assert H.find(small, 1)["status"].tolist() == ["not_contained"]


GOOD = {
    "domain": {"radius": 20.0, "height": 20.0, "cell_size": 6, "cell_ghost": 3, "global_refine": 1},
    "limits": {"max_levels": 8},
    "initial": {"relax": {"cfl": 0.1, "dampening": 0.4, "tolerance": 1e-6}},
    "evolve": {"cfl": 0.1},
    "output": {"initial_relax_interval": {"steps": 10}, "horizon_relax_interval": {"steps": 10}},
    "error_handler": {n: "crash" for n in settings.LIMITS},
}


def test_settings():
    assert settings.validate(GOOD) is GOOD
    for path, value in (("domain.height", 0), ("domain.cell_size", 5), ("domain.global_refine", 8), ("evolve.cfl", -1.0), ("output.initial_relax_interval", {"time": 1.0}), ("error_handler.on_max_nodes", "ignore"), ("error_handler.on_max_initial_steps", "collapse")):
        bad = copy.deepcopy(GOOD)
        *above, last = path.split(".")
        settings.setting(bad, ".".join(above))[last] = value
        assert len(settings.faults(bad)) == 1
        with pytest.raises(ValueError, match=last):
            settings.validate(bad)
    with pytest.raises(ValueError, match="not set"):
        settings.validate({})


def test_crash_is_an_error(spark):
    x = spark.createDataFrame([(True, "crash")], "hit boolean, s string")
    with pytest.raises(Exception, match="limit"):
        x.select(settings.outcome(F.col("hit"), F.col("s"))).collect()
    assert x.select(settings.outcome(~F.col("hit"), F.col("s")).alias("o")).first().o is None


def test_float_keys(spark):
    values = [0.0, -0.0, 1.5, -1.5, 1e308, 5e-324, float("inf"), float("nan"), None]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", N.float_key(F.col("v")).alias("k")).orderBy("i").collect()
    assert [r.k for r in got] == [None if v is None else N.encode_float(v) for v in values]
    assert N.decode_float(got[2].k) == 1.5
