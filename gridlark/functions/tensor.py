"""Small tensors at one point, as columns or numbers for each component.

A tensor is a dict from index tuples to anything with ``+`` and ``*``: Columns in queries, floats or arrays
in kernels. Symmetric storage keeps each class of indices once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import product

Tensor = dict[tuple[int, ...], object]


def indices(rank: int, dims: int = 2) -> Iterable[tuple[int, ...]]:
    return product(range(dims), repeat=rank)


def build(rank: int, f: Callable, dims: int = 2) -> Tensor:
    return {i: f(*i) for i in indices(rank, dims)}


def symmetric(f: Callable, dims: int = 2) -> Tensor:
    """A rank-2 tensor whose components are made once for each pair."""
    own = {(i, j): f(i, j) for i in range(dims) for j in range(i + 1)}
    return {(i, j): own[max(i, j), min(i, j)] for i, j in indices(2, dims)}


def packed_place(index: tuple[int, ...], layout: str, dims: int = 2) -> int:
    """The place of a component in packed storage; layouts: 'v' vector, 's' symmetric pair, in order."""
    place, at = 0, 0
    for kind in layout:
        if kind == "v":
            place, at = place * dims + index[at], at + 1
        else:
            i, j = max(index[at], index[at + 1]), min(index[at], index[at + 1])
            place, at = place * (dims * (dims + 1) // 2) + i * (i + 1) // 2 + j, at + 2
    return place


def total(terms: Iterable):
    out = None
    for t in terms:
        out = t if out is None else out + t
    return 0.0 if out is None else out


def contract(spec: str, *tensors: Tensor, dims: int = 2):
    """``contract("ik,kj->ij", a, b)``: repeated indices that the result lacks are summed."""
    left, _, right = spec.partition("->")
    groups = left.split(",")
    free = list(right)
    summed = sorted({c for g in groups for c in g} - set(free))

    def component(values: dict[str, int]):
        def term(extra):
            at = values | dict(zip(summed, extra, strict=True))
            out = None
            for g, t in zip(groups, tensors, strict=True):
                x = t[tuple(at[c] for c in g)]
                out = x if out is None else out * x
            return out

        return total(term(extra) for extra in product(range(dims), repeat=len(summed)))

    if not free:
        return component({})
    return {i: component(dict(zip(free, i, strict=True))) for i in indices(len(free), dims)}


class Metric:
    """A 2-D metric with its first and, if given, second partial derivatives (last indices derive)."""

    def __init__(self, g: Tensor, dg: Tensor, ddg: Tensor | None = None):
        self.g, self.dg, self.ddg = g, dg, ddg

    def det(self):
        g = self.g
        return g[0, 0] * g[1, 1] - g[0, 1] * g[0, 1]

    def det_derivs(self) -> Tensor:
        g, d = self.g, self.dg
        return {(k,): d[0, 0, k] * g[1, 1] + g[0, 0] * d[1, 1, k] - 2.0 * (g[0, 1] * d[0, 1, k]) for k in range(2)}

    def inverse(self) -> Tensor:
        g, det = self.g, self.det()
        return {(0, 0): g[1, 1] / det, (1, 1): g[0, 0] / det, (0, 1): -g[0, 1] / det, (1, 0): -g[0, 1] / det}

    def inverse_derivs(self) -> Tensor:
        """``-g^{im} g^{jn} d_k g_mn``."""
        inv = self.inverse()
        return {i: -v for i, v in contract("im,jn,mnk->ijk", inv, inv, self.dg).items()}

    def christoffel_first(self) -> Tensor:
        """With the derivative's index last: ``1/2 (d_k g_ij + d_j g_ik - d_i g_jk)``."""
        d = self.dg
        return build(3, lambda i, j, k: 0.5 * (d[i, j, k] + d[i, k, j] - d[j, k, i]))

    def christoffel(self) -> Tensor:
        return contract("im,mjk->ijk", self.inverse(), self.christoffel_first())

    def christoffel_derivs(self) -> Tensor:
        """Partial derivatives of the second kind, last index."""
        if self.ddg is None:
            raise ValueError("second derivatives of the metric are needed")
        h = self.ddg
        first = build(4, lambda i, j, k, n: 0.5 * (h[i, j, k, n] + h[i, k, j, n] - h[j, k, i, n]))
        a = contract("im,mjkn->ijkn", self.inverse(), first)
        b = contract("imn,mjk->ijkn", self.inverse_derivs(), self.christoffel_first())
        return {i: a[i] + b[i] for i in a}

    def ricci(self) -> Tensor:
        gamma, d = self.christoffel(), self.christoffel_derivs()
        return build(2, lambda i, j: total([d[m, i, j, m] - d[m, i, m, j] + total(gamma[m, m, n] * gamma[n, i, j] - gamma[m, j, n] * gamma[n, i, m] for n in range(2)) for m in range(2)]))

    def killing(self, x: Tensor, dx: Tensor) -> Tensor:
        """The Lie derivative of the metric along a vector, ``dx[i, k] = d_k x^i``."""
        g, d = self.g, self.dg
        return build(2, lambda i, j: total(x[m,] * d[i, j, m] + g[m, j] * dx[m, i] + g[i, m] * dx[m, j] for m in range(2)))

    def cotrace(self, t: Tensor):
        return contract("ij,ij->", self.inverse(), t)

    def raise_first(self, t: Tensor) -> Tensor:
        return contract("im,mj->ij", self.inverse(), t)

    def raise_last(self, t: Tensor) -> Tensor:
        return contract("im,jm->ij", t, self.inverse())

    def scalar_hessian(self, du: Tensor, ddu: Tensor) -> Tensor:
        gamma = self.christoffel()
        return build(2, lambda i, j: ddu[i, j] - total(gamma[m, i, j] * du[m,] for m in range(2)))

    def covector_gradient(self, v: Tensor, dv: Tensor) -> Tensor:
        """``D_j v_i`` at [i, j]."""
        gamma = self.christoffel()
        return build(2, lambda i, j: dv[i, j] - total(gamma[m, i, j] * v[m,] for m in range(2)))

    def symmetric_gradient(self, t: Tensor, dt: Tensor) -> Tensor:
        """``D_k t_ij`` at [i, j, k]."""
        gamma = self.christoffel()
        return build(3, lambda i, j, k: dt[i, j, k] - total(gamma[m, i, k] * t[m, j] + gamma[m, j, k] * t[i, m] for m in range(2)))


def scalar_lie(x: Tensor, du: Tensor):
    return total(x[m,] * du[m,] for m in range(2))


def covector_lie(x: Tensor, dx: Tensor, v: Tensor, dv: Tensor) -> Tensor:
    return {(i,): total(x[m,] * dv[i, m] + v[m,] * dx[m, i] for m in range(2)) for i in range(2)}


def symmetric_lie(x: Tensor, dx: Tensor, t: Tensor, dt: Tensor) -> Tensor:
    return build(2, lambda i, j: total(x[m,] * dt[i, j, m] + t[m, j] * dx[m, i] + t[i, m] * dx[m, j] for m in range(2)))
