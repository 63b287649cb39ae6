"""Exact stencil weights: rational solutions of the moment conditions on a set of nodes."""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction
from functools import cache


def moment_weights(nodes: tuple[Fraction, ...], at: Fraction, derivative: int = 0) -> tuple[Fraction, ...]:
    """Weights w with ``sum(w * p(node)) == p^(derivative)(at)`` for all polynomials below ``len(nodes)``."""
    n = len(nodes)
    if len(set(nodes)) < n:
        raise ValueError("nodes must differ")
    rows = [[Fraction(x) ** m for x in nodes] for m in range(n)]
    right = []
    for m in range(n):
        factor = Fraction(1)
        for k in range(derivative):
            factor *= m - k
        right.append(factor * (Fraction(at) ** (m - derivative)) if m >= derivative else Fraction(0))
    for c in range(n):  # Gauss-Jordan
        pivot = next(r for r in range(c, n) if rows[r][c])
        rows[c], rows[pivot], right[c], right[pivot] = rows[pivot], rows[c], right[pivot], right[c]
        scale = rows[c][c]
        rows[c] = [x / scale for x in rows[c]]
        right[c] /= scale
        for r in range(n):
            if r != c and rows[r][c]:
                f = rows[r][c]
                rows[r] = [x - f * y for x, y in zip(rows[r], rows[c], strict=True)]
                right[r] -= f * right[c]
    return tuple(right)


def vertex_grid(left: int, right: int) -> tuple[Fraction, ...]:
    """Whole positions -left .. right."""
    return tuple(Fraction(k) for k in range(-left, right + 1))


def cell_grid(left: int, right: int) -> tuple[Fraction, ...]:
    """Half positions: ``left`` of them below 0 and ``right`` above."""
    return tuple(Fraction(2 * k + 1, 2) for k in range(-left, right))


@dataclass(frozen=True)
class Kernel:
    """A stencil on one axis: a centred form, forms for the first places of an edge, and a spacing power.

    ``interior`` maps offsets to weights. ``left[p]`` are the weights on nodes 0, 1, ... at place p. The
    right edge is the mirror image, times ``mirror``.
    """

    name: str
    interior: dict[int, float] = field(hash=False)
    left: tuple[tuple[float, ...], ...]
    power: int = 0
    mirror: int = 1
    factor: float = 1.0

    @property
    def border(self) -> int:
        return max(map(abs, self.interior))

    def scale(self, h: float) -> float:
        return self.factor / h**self.power


VALUE = Kernel("value", {0: 1.0}, ())


@cache
def derivative(order: int, degree: int = 1) -> Kernel:
    """First or second derivative of order 2, 4 or 6; the edge of a second derivative has a node more."""
    if order not in (2, 4, 6) or degree not in (1, 2):
        raise ValueError(f"no derivative of degree {degree} and order {order}")
    half = order // 2
    centred = moment_weights(vertex_grid(half, half), Fraction(0), degree)
    edge = vertex_grid(0, order + degree - 1)
    left = tuple(tuple(float(w) for w in moment_weights(edge, Fraction(p), degree)) for p in range(half))
    return Kernel(f"d{degree}o{order}", {k - half: float(w) for k, w in enumerate(centred)}, left, degree, -1 if degree == 1 else 1)


#: One-sided rows of the Kreiss-Oliger filters.
KO_EDGES = {
    4: ((3, -14, 26, -24, 11, -2), (2, -9, 16, -14, 6, -1)),
    6: ((4, -27, 78, -125, 120, -69, 22, -3), (3, -20, 57, -90, 85, -48, 15, -2), (2, -13, 36, -55, 50, -27, 8, -1)),
}


@cache
def dissipation(order: int) -> Kernel:
    """Kreiss-Oliger filter: an even difference, scaled by -1/16 (order 4) or 1/64 (order 6), not by spacing."""
    if order not in KO_EDGES:
        raise ValueError(f"no dissipation of order {order}")
    row = [1]
    for _ in range(order):
        row = [a - b for a, b in zip([*row, 0], [0, *row], strict=True)]
    half = order // 2
    edges = tuple(tuple(float(x) for x in r) for r in KO_EDGES[order])
    return Kernel(f"ko{order}", {k - half: float(x) for k, x in enumerate(row)}, edges, 0, 1, -1 / 16 if order == 4 else 1 / 64)


@cache
def beyond(n: int) -> tuple[float, ...]:
    """The value a step past a node, from it and every second one before it, ``n`` in all, the nearest first."""
    return tuple(float(w) for w in moment_weights(tuple(Fraction(-2 * k - 1) for k in range(n)), Fraction(0)))


@cache
def interpolation(order: int) -> Kernel:
    """The value half a cell to the right of a node, from ``order + 2`` nodes.

    ``interior`` has offsets from the node on the left; ``left[p]`` weighs nodes 0, 1, ... for the midpoint
    of cell p. The last cells mirror the first.
    """
    if order not in (2, 4):
        raise ValueError(f"no interpolation of order {order}")
    half = (order + 2) // 2
    centred = moment_weights(cell_grid(half, half), Fraction(0))
    edge = vertex_grid(0, order + 1)
    left = tuple(tuple(float(w) for w in moment_weights(edge, Fraction(2 * p + 1, 2))) for p in range(half - 1))
    return Kernel(f"i{order}", {k - half + 1: float(w) for k, w in enumerate(centred)}, left)
