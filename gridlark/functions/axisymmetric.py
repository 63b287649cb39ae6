"""Equations on a half plane (r, z) around an axis of symmetry.

A quantity at a point is a :class:`Jet`, its value with first and second derivatives, as arrays, so a kernel treats a
batch of nodes at once. The circumference of the axis' circles is 2 pi lambda with ``lambda = r exp(r s) sqrt(g_rr)``,
so ``log lambda = log r + m`` with the regular ``m = r s + log(g_rr) / 2``. Terms over r take their limit on the axis,
the derivative of what is divided (:meth:`Plane.over_r`); this is the only place where the axis differs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from . import tensor as X
from . import weights as K

KAPPA = 8.0 * np.pi
ON_AXIS = 1e-10
GAUGES = ("harmonic", "harmonic_zero_shift", "log_plus_one", "log_plus_one_zero_shift", "k_driver_zero_shift")


@dataclass
class Jet:
    """A value, its derivatives along r and z, and its second derivatives (0, 0), (0, 1), (1, 1)."""

    v: np.ndarray
    d: tuple = (0.0, 0.0)
    dd: tuple = (0.0, 0.0, 0.0)

    def second(self, i: int, j: int):
        return self.dd[i + j]


def values(jets: X.Tensor) -> X.Tensor:
    return {i: j.v for i, j in jets.items()}


def derivs(jets: X.Tensor) -> X.Tensor:
    return {(*i, k): j.d[k] for i, j in jets.items() for k in range(2)}


def seconds(jets: X.Tensor) -> X.Tensor:
    return {(*i, k, n): j.second(k, n) for i, j in jets.items() for k in range(2) for n in range(2)}


def pair(rr, rz, zz) -> X.Tensor:
    return {(0, 0): rr, (0, 1): rz, (1, 0): rz, (1, 1): zz}


@dataclass
class Matter:
    """A scalar field, its rate and its mass."""

    phi: Jet
    pi: Jet
    mass: float = 0.0


@dataclass
class Plane:
    """The geometry of a time slice: r, metric and seed, and what follows from them."""

    r: np.ndarray
    metric: X.Tensor
    seed: Jet
    m: X.Metric = field(init=False)

    def __post_init__(self):
        self.r = np.asarray(self.r, float)
        self.axis = np.abs(self.r) <= ON_AXIS
        self.m = X.Metric(values(self.metric), derivs(self.metric), seconds(self.metric))
        self.inv, self.inv_d = self.m.inverse(), self.m.inverse_derivs()
        self.gamma, self.gamma_d = self.m.christoffel(), self.m.christoffel_derivs()
        g, s = self.metric[0, 0], self.seed
        #: derivatives of m, the regular part of log lambda
        self.dm = {(k,): self.r * s.d[k] + (s.v if k == 0 else 0.0) + g.d[k] / (2 * g.v) for k in range(2)}
        self.ddm = X.build(2, lambda i, j: self.r * s.second(i, j) + (i == 0) * s.d[j] + (j == 0) * s.d[i] + g.second(i, j) / (2 * g.v) - g.d[i] * g.d[j] / (2 * g.v * g.v))

    def over_r(self, value, derivative):
        """``value / r``, and on the axis, where the value is zero, its derivative along r."""
        return np.where(self.axis, derivative, value / np.where(self.axis, 1.0, self.r))

    def along(self, w: X.Tensor, dw_r):
        """``w_a D^a log lambda`` for a covector whose r component vanishes on the axis; ``dw_r`` is that one's derivative."""
        up = X.contract("ab,b->a", self.inv, w)
        d = self.inv[0, 0] * dw_r + self.inv_d[0, 1, 0] * w[1,]
        return X.contract("a,a->", up, self.dm) + self.over_r(up[0,], d)

    def hessian(self) -> X.Tensor:
        """``D_a D_b lambda / lambda``.

        The terms in 1 / r^2 of the second derivative of log lambda and of the square of its first cancel.
        """
        g, s = self.metric, self.seed
        regular = X.build(2, lambda i, j: self.ddm[i, j] + self.dm[i,] * self.dm[j,] - X.total(self.gamma[k, i, j] * self.dm[k,] for k in range(2)))
        # what stands over r: both sides' gradients of m, less the connection's r part
        rr = self.over_r(2 * self.dm[0,] - self.gamma[0, 0, 0], 2 * self.ddm[0, 0] - self.gamma_d[0, 0, 0, 0])
        # m_z - gamma^r_rz = r s_z + (the part of gamma^r_rz that g^rz makes)
        rest = g[0, 0].d[1] / (2 * g[0, 0].v) - self.gamma[0, 0, 1]
        rest_d = g[0, 0].second(0, 1) / (2 * g[0, 0].v) - g[0, 0].d[0] * g[0, 0].d[1] / (2 * g[0, 0].v ** 2) - self.gamma_d[0, 0, 1, 0]
        rz = s.d[1] + self.over_r(rest, rest_d)
        zz = self.over_r(-self.gamma[0, 1, 1], -self.gamma_d[0, 1, 1, 0])
        return {i: regular[i] + x for i, x in pair(rr, rz, zz).items()}


def scalar_source(plane: Plane, matter: Matter) -> dict[str, object]:
    """Energy, momentum, stress and angular stress of a scalar field."""
    phi, pi, m2 = matter.phi, matter.pi, matter.mass**2
    du = {(k,): phi.d[k] for k in range(2)}
    square = X.contract("ij,i,j->", plane.inv, du, du)
    angular = 0.5 * (pi.v**2 - square - m2 * phi.v**2)
    return {
        "energy": 0.5 * (pi.v**2 + square + m2 * phi.v**2),
        "momentum": {i: -pi.v * x for i, x in du.items()},
        "stress": X.build(2, lambda i, j: du[i,] * du[j,] + plane.m.g[i, j] * angular),
        "angular": angular,
    }


def total_source(plane: Plane, fields: list[Matter]) -> dict[str, object]:
    """The sum over all fields; zero in a vacuum."""
    parts = [scalar_source(plane, f) for f in fields]
    none = np.zeros_like(plane.r)
    return {
        "energy": sum((p["energy"] for p in parts), none),
        "momentum": {(i,): sum((p["momentum"][i,] for p in parts), none) for i in range(2)},
        "stress": X.build(2, lambda i, j: sum((p["stress"][i, j] for p in parts), none)),
        "angular": sum((p["angular"] for p in parts), none),
    }


@dataclass
class Slice:
    """All fields of the evolution at a batch of points."""

    plane: Plane
    k: X.Tensor  # extrinsic curvature of the half plane
    y: Jet  # (L - K_rr / g_rr) / r, with L that of the circles
    theta: Jet
    z: X.Tensor
    lapse: Jet
    shift: X.Tensor
    matter: list[Matter] = field(default_factory=list)

    def __post_init__(self):
        g, k, r = self.plane.metric[0, 0], self.k[0, 0], self.plane.r
        d = tuple(r * self.y.d[a] + (self.y.v if a == 0 else 0.0) + k.d[a] / g.v - k.v * g.d[a] / g.v**2 for a in range(2))
        self.circles = Jet(r * self.y.v + k.v / g.v, d)


def constraints(x: Slice) -> tuple[np.ndarray, X.Tensor]:
    """The Hamiltonian and the momentum constraint; zero for solutions."""
    p, ell = x.plane, x.circles
    k, dk, src = values(x.k), derivs(x.k), total_source(x.plane, x.matter)
    trace = p.m.cotrace(k)
    squared = X.contract("am,bn,ab,mn->", p.inv, p.inv, k, k)
    ham = 0.5 * (p.m.cotrace(p.m.ricci()) + trace**2 - squared) + trace * ell.v - p.m.cotrace(p.hessian()) - KAPPA * src["energy"]
    dtrace = {(i,): X.total(dk[m, n, i] * p.inv[m, n] + k[m, n] * p.inv_d[m, n, i] for m in range(2) for n in range(2)) for i in range(2)}
    divergence = X.contract("imn,mn->i", p.m.symmetric_gradient(k, dk), p.inv)

    def circles(i):
        """K_i^m d_m log lambda less L d_i log lambda; over r stands K_i^r - L delta_i^r."""
        up = {m: X.total(p.inv[m, n] * k[n, i] for n in range(2)) for m in range(2)}
        value = up[0] - (ell.v if i == 0 else 0.0)
        slope = X.total(p.inv_d[0, n, 0] * k[n, i] + p.inv[0, n] * dk[n, i, 0] for n in range(2)) - (ell.d[0] if i == 0 else 0.0)
        return X.total(up[m] * p.dm[m,] for m in range(2)) - ell.v * p.dm[i,] + p.over_r(value, slope)

    mom = {(i,): divergence[i,] - dtrace[i,] - ell.d[i] + circles(i) - KAPPA * src["momentum"][i,] for i in range(2)}
    return ham, mom


def rates(x: Slice, gauge: str = "harmonic") -> dict[str, object]:
    """Time derivatives of all fields of the geometry."""
    if gauge not in GAUGES:
        raise ValueError(f"no gauge {gauge}")
    p, ell, lapse, src = x.plane, x.circles, x.lapse, total_source(x.plane, x.matter)
    g, k, dk, th = p.m.g, values(x.k), derivs(x.k), x.theta
    b, db, z, dz = values(x.shift), derivs(x.shift), values(x.z), derivs(x.z)
    hess, ricci, trace = p.hessian(), p.m.ricci(), p.m.cotrace(k)
    ham, mom = constraints(x)
    a, da = lapse.v, {(i,): lapse.d[i] for i in range(2)}
    dda = p.m.scalar_hessian(da, X.build(2, lapse.second))
    grad_z = p.m.covector_gradient(z, dz)
    up_z = X.contract("ij,j->i", p.inv, z)
    whole = trace + ell.v
    pressure = p.m.cotrace(src["stress"])

    g_moved = p.m.killing(b, db)
    g_t = {i: -2 * a * k[i] + g_moved[i] for i in g}
    lam_t = -a * ell.v + X.contract("a,a->", p.dm, b) + p.over_r(b[0,], db[0, 0])

    k_moved, kk = X.symmetric_lie(b, db, k, dk), X.contract("am,mn,nb->ab", k, p.inv, k)
    k_t = {}
    for i in g:
        i2 = (i[1], i[0])
        inner = ricci[i] - hess[i] + (whole - 2 * th.v) * k[i] - 2 * kk[i] + grad_z[i] + grad_z[i2]
        inner = inner - KAPPA * (src["stress"][i] + 0.5 * (src["energy"] - pressure - src["angular"]) * g[i])
        k_t[i] = a * inner - dda[i] + k_moved[i]

    w = {(i,): 2 * a * z[i,] - da[i,] for i in range(2)}
    w_r = 2 * (lapse.d[0] * z[0,] + a * dz[0, 0]) - lapse.second(0, 0)
    l_t = a * (ell.v * (whole - 2 * th.v) - p.m.cotrace(hess) - 0.5 * KAPPA * (src["energy"] - pressure + src["angular"])) + p.along(w, w_r) + X.total(b[i,] * ell.d[i] for i in range(2))

    expansion = p.m.cotrace(grad_z) + p.along(z, dz[0, 0])
    along_n = a * (ham - whole * th.v + expansion) - X.total(da[i,] * up_z[i,] for i in range(2))
    theta_t = along_n + X.total(b[i,] * th.d[i] for i in range(2))
    z_moved = X.covector_lie(b, db, z, dz)
    z_t = {(i,): a * (mom[i,] - 2 * X.total(k[i, m] * up_z[m,] for m in range(2)) + th.d[i]) - da[i,] * th.v + z_moved[i,] for i in range(2)}

    safe = np.where(p.axis, 1.0, p.r)
    y_t = np.where(p.axis, 0.0, (l_t - k_t[0, 0] / g[0, 0] + k[0, 0] * g_t[0, 0] / g[0, 0] ** 2) / safe)
    seed_t = np.where(p.axis, 0.0, (lam_t - 0.5 * g_t[0, 0] / g[0, 0]) / safe)

    moved = X.total(b[i,] * da[i,] for i in range(2))
    none = np.zeros_like(p.r)
    lapse_t, shift_t = none, {(0,): none, (1,): none}
    if gauge.startswith("harmonic"):
        lapse_t = moved - a * a * (whole - 2 * th.v)
    elif gauge.startswith("log"):
        lapse_t = moved - 2 * a * (whole - 2 * th.v)
    else:
        # the rate of K: from the lapse's Laplacian in three dimensions, the curvature's square, matter and damping
        laplacian = p.m.cotrace(dda) + p.along(da, lapse.second(0, 0))
        square = X.contract("ij,ij->", k, X.contract("am,bn,mn->ab", p.inv, p.inv, k))
        grown = a * (square + ell.v**2) - laplacian + 0.5 * KAPPA * a * (src["energy"] + pressure + src["angular"])
        lapse_t = -(grown + 2 * along_n + 2 * X.total(up_z[i,] * da[i,] for i in range(2))) - trace
    if not gauge.endswith("zero_shift"):
        half_det = {(i,): d / (2 * p.m.det()) + p.dm[i,] for i, d in ((i, p.m.det_derivs()[i,]) for i in range(2))}
        for i in range(2):
            # the contracted connection, without the part g^rr / r that flat space has as well
            spread = X.total(p.inv[i, n] * half_det[n,] for n in range(2)) + X.total(p.inv_d[i, n, n] for n in range(2))
            spread = spread + (p.over_r(p.inv[0, 1], p.inv_d[0, 1, 0]) if i else 0.0)
            drive = X.total(p.inv[i, n] * (2 * a * a * z[n,] - a * da[n,]) for n in range(2))
            shift_t[i,] = drive - a * a * spread + X.total(b[n,] * db[i, n] for n in range(2))
    return {"g": g_t, "seed": seed_t, "k": k_t, "y": y_t, "theta": theta_t, "z": z_t, "lapse": lapse_t, "shift": shift_t, "hamiltonian": ham, "momentum": mom}


def matter_rates(x: Slice, matter: Matter) -> tuple[np.ndarray, np.ndarray]:
    """Rates of a scalar field and of its rate, by the wave equation in curved space."""
    p, phi, pi, a = x.plane, matter.phi, matter.pi, x.lapse.v
    du = {(i,): phi.d[i] for i in range(2)}
    laplacian = p.m.cotrace(p.m.scalar_hessian(du, X.build(2, phi.second))) + p.along(du, phi.second(0, 0))
    b = values(x.shift)
    phi_t = a * pi.v + X.total(b[i,] * phi.d[i] for i in range(2))
    drag = X.total(du[i,] * p.inv[i, j] * x.lapse.d[j] for i in range(2) for j in range(2))
    pi_t = a * (laplacian + pi.v * (p.m.cotrace(values(x.k)) + x.circles.v) - matter.mass**2 * phi.v) + drag + X.total(b[i,] * pi.d[i] for i in range(2))
    return phi_t, pi_t


def polar(radius, theta):
    """(r, z) of a curve around the origin; neither is negative."""
    return np.maximum(radius * np.cos(theta), 0.0), np.maximum(radius * np.sin(theta), 0.0)


def null_expansion(plane: Plane, k: X.Tensor, y: Jet, theta, radius, slope, bend):
    """Expansion of the outgoing light rays of the surface ``radius(theta)`` turned around the axis.

    The divergence of the normal is the curve's geodesic curvature plus the normal's derivative of log lambda.
    """
    c, s = np.cos(theta), np.sin(theta)
    t = {(0,): slope * c - radius * s, (1,): slope * s + radius * c}
    tt = {(0,): bend * c - 2 * slope * s - radius * c, (1,): bend * s + 2 * slope * c - radius * s}
    length2 = X.contract("ij,i,j->", plane.m.g, t, t)
    scale = np.sqrt(plane.m.det() / length2)
    n = {(0,): scale * t[1,], (1,): -scale * t[0,]}  # covector across the curve, outwards
    turned = {(i,): tt[i,] + X.total(plane.gamma[i, a, b] * t[a,] * t[b,] for a in range(2) for b in range(2)) for i in range(2)}
    bent = -X.contract("i,i->", n, turned) / length2
    across = plane.along(n, scale * tt[1,] / np.where(plane.axis, t[0,], 1.0))
    kv = values(k)
    up = X.contract("ij,j->i", plane.inv, n)
    circles = plane.r * y.v + kv[0, 0] / plane.m.g[0, 0]
    return bent + across + X.contract("ij,i,j->", kv, up, up) - plane.m.cotrace(kv) - circles


def jet_of(f, r, z, h: float = 2e-3) -> Jet:
    """The jet of a closed form ``f(r, z)``, by central differences of fourth order."""
    first, second = K.derivative(4), K.derivative(4, 2)
    sweep = lambda kernel, g: sum(w * g(o * h) for o, w in kernel.interior.items()) * kernel.scale(h)
    mixed = sweep(first, lambda a: sweep(first, lambda b: f(r + a, z + b)))
    return Jet(
        f(r, z),
        (sweep(first, lambda a: f(r + a, z)), sweep(first, lambda b: f(r, z + b))),
        (sweep(second, lambda a: f(r + a, z)), mixed, sweep(second, lambda b: f(r, z + b))),
    )


def falling_slices(r, z, mass):
    """A black hole on slices that fall in from rest: plane, extrinsic curvature, y, lapse and shift.

    The slices are flat, ``K_ij = d_i beta_j``, and the shift is ``sqrt(2 m / R)`` inwards in time.
    """
    r, z = np.asarray(r, float), np.asarray(z, float)
    flat = lambda r, z: np.ones_like(r + z)
    none = lambda r, z: np.zeros_like(r + z)
    jet = lambda f: jet_of(f, r, z)
    ratio = lambda r, z: np.sqrt(2 * mass) * (r * r + z * z) ** -0.75
    fall = lambda r, z: -1.5 * ratio(r, z) / (r * r + z * z)
    plane = Plane(r, pair(jet(flat), jet(none), jet(flat)), jet(none))
    k = pair(jet(lambda r, z: ratio(r, z) + r * r * fall(r, z)), jet(lambda r, z: r * z * fall(r, z)), jet(lambda r, z: ratio(r, z) + z * z * fall(r, z)))
    shift = {(0,): jet(lambda r, z: r * ratio(r, z)), (1,): jet(lambda r, z: z * ratio(r, z))}
    return plane, k, jet(lambda r, z: -r * fall(r, z)), jet(flat), shift


def at_rest(r, z) -> tuple[Jet, X.Tensor]:
    """Zero: a scalar and a covector."""
    none = np.zeros_like(np.asarray(r, float) + np.asarray(z, float))
    return Jet(none), {(0,): Jet(none), (1,): Jet(none)}
