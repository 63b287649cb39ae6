"""Stencils on node tables, as window expressions.

A node table has columns for the block, one whole-number column for each axis and one DOUBLE column for each
channel. All offsets of a stencil share one window (partitioned by block and the other axes), so a
derivative is one sort, however many nodes it reads.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import weights as K


@dataclass(frozen=True)
class Grid:
    """Uniform blocks: vertices 0 .. cells[a] on axis a, ``spacing[a]`` apart from ``origin[a]`` on.

    free: for each axis, whether its lower and its upper edge has no ghost nodes. Spacing, origin and edges may be columns
    instead, which differ from block to block.
    """

    block: tuple[str, ...]
    axes: tuple[str, ...]
    cells: tuple[int, ...]
    spacing: tuple[float, ...]
    origin: tuple[float, ...] | None = None
    free: tuple[tuple[bool, bool], ...] | None = None

    def edges(self, axis: int) -> tuple[bool, bool]:
        return self.free[axis] if self.free else (True, True)

    def window(self, axis: int):
        others = [a for k, a in enumerate(self.axes) if k != axis]
        return W.partitionBy(*self.block, *others).orderBy(self.axes[axis])

    def position(self, axis: int) -> Column:
        start = self.origin[axis] if self.origin else 0.0
        return F.lit(start) + F.col(self.axes[axis]) * F.lit(self.spacing[axis])


def total(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def apply_axis(grid: Grid, kernel: K.Kernel, axis: int, u: Column | str) -> Column:
    """The kernel along one axis: its centred form, or the edge's form within reach of an edge without ghosts."""
    u = F.col(u) if isinstance(u, str) else u
    w = grid.window(axis)

    def at(k: int) -> Column:
        return u if k == 0 else F.lead(u, k).over(w) if k > 0 else F.lag(u, -k).over(w)

    def weighted(pairs) -> Column:
        return total([F.lit(float(x)) * at(k) for k, x in pairs if x])

    i, n = F.col(grid.axes[axis]), grid.cells[axis]
    out = weighted(sorted(kernel.interior.items()))
    low, high = grid.edges(axis)
    for p, row in enumerate(kernel.left):
        if high is not False:
            out = F.when((i == n - p) & high, weighted([(p - k, kernel.mirror * x) for k, x in enumerate(row)])).otherwise(out)
        if low is not False:
            out = F.when((i == p) & low, weighted([(k - p, x) for k, x in enumerate(row)])).otherwise(out)
    return out * F.lit(kernel.scale(grid.spacing[axis]))


class Engine:
    """What a user function may ask for at a vertex. Products of stencils are staged as further columns."""

    def __init__(self, df: DataFrame, grid: Grid, order: int = 4):
        self.df, self.grid, self.order, self.staged = df, grid, order, []

    def value(self, u: str) -> Column:
        return F.col(u)

    def position(self, axis: int) -> Column:
        return self.grid.position(axis)

    def derivative(self, u: str, axis: int) -> Column:
        return apply_axis(self.grid, K.derivative(self.order), axis, u)

    def second_derivative(self, u: str, axis: int) -> Column:
        return apply_axis(self.grid, K.derivative(self.order, 2), axis, u)

    def mixed_derivative(self, u: str, a: int, b: int) -> Column:
        if a == b:
            return self.second_derivative(u, a)
        name = f"__d{a}_{u}"
        if name not in self.staged:
            self.df = self.df.withColumn(name, self.derivative(u, a))
            self.staged.append(name)
        return self.derivative(name, b)

    def gradient(self, u: str) -> list[Column]:
        return [self.derivative(u, a) for a in range(len(self.grid.axes))]

    def hessian(self, u: str) -> list[list[Column]]:
        n = range(len(self.grid.axes))
        return [[self.mixed_derivative(u, min(a, b), max(a, b)) for b in n] for a in n]

    def dissipation(self, u: str, axis: int) -> Column:
        return apply_axis(self.grid, K.dissipation(self.order), axis, u)


def evaluate(df: DataFrame, grid: Grid, f: Callable[[Engine], dict[str, Column]], order: int = 4) -> DataFrame:
    """Applies a user function to every vertex: block, axes and the columns that ``f`` returns."""
    engine = Engine(df, grid, order)
    out = f(engine)
    return engine.df.select(*grid.block, *grid.axes, *[c.alias(k) for k, c in out.items()])


def project(df: DataFrame, grid: Grid, f: Callable[[list[Column]], Column], name: str) -> DataFrame:
    """Writes ``f(position)`` to a channel of every vertex."""
    return df.withColumn(name, f([grid.position(a) for a in range(len(grid.axes))]))


def dissipate(df: DataFrame, grid: Grid, u: str, amplitude: float, order: int = 6) -> DataFrame:
    """``u`` plus ``amplitude`` times the filter on every axis, all from the same source."""
    parts = [apply_axis(grid, K.dissipation(order), a, u) for a in range(len(grid.axes))]
    return df.withColumn(u, F.col(u) + F.lit(amplitude) * total(parts))


def prolong(df: DataFrame, grid: Grid, u: str, order: int = 4) -> DataFrame:
    """Doubles the resolution, axis by axis from the last: even nodes copy, odd nodes interpolate."""
    kernel = K.interpolation(order)
    out, cells = df.select(*grid.block, *grid.axes, u), list(grid.cells)
    for axis in reversed(range(len(grid.axes))):
        name, n = grid.axes[axis], cells[axis]
        g = Grid(grid.block, grid.axes, tuple(cells), grid.spacing)
        i, w = F.col(name), g.window(axis)
        at = lambda k: F.col(u) if k == 0 else F.lead(u, k).over(w) if k > 0 else F.lag(u, -k).over(w)  # noqa: B023, E731
        weighted = lambda pairs: total([F.lit(x) * at(k) for k, x in pairs])  # noqa: B023, E731
        mid = weighted(sorted(kernel.interior.items()))
        for p, row in enumerate(kernel.left):
            mid = F.when(i == n - 1 - p, weighted([(p + 1 - k, x) for k, x in enumerate(row)])).otherwise(mid)
            mid = F.when(i == p, weighted([(k - p, x) for k, x in enumerate(row)])).otherwise(mid)
        staged = out.withColumn("__mid", mid)
        both = F.array(F.struct((2 * i).alias("k"), F.col(u).alias("v")), F.struct((2 * i + 1).alias("k"), F.col("__mid").alias("v")))
        staged = staged.withColumn("__e", F.explode(F.when(i < n, both).otherwise(F.slice(both, 1, 1))))
        out = staged.select(*grid.block, *[F.col("__e.k").alias(name) if a == name else F.col(a) for a in grid.axes], F.col("__e.v").alias(u))
        cells[axis] = 2 * n
    return out


def inject(df: DataFrame, grid: Grid) -> DataFrame:
    """Halves the resolution: even nodes only, renumbered."""
    keep = None
    for a in grid.axes:
        keep = F.col(a) % 2 == 0 if keep is None else keep & (F.col(a) % 2 == 0)
    out = df.filter(keep)
    for a in grid.axes:
        out = out.withColumn(a, F.floor(F.col(a) / 2).cast(df.schema[a].dataType))
    return out


def wavelet_detail(df: DataFrame, grid: Grid, u: str, order: int = 4) -> DataFrame:
    """Interpolated minus actual value at every node with an odd place; 0 at the others.

    On one axis the number of cells may be odd; the last node is then predicted from the even ones before it.
    """
    uneven = [a for a, c in enumerate(grid.cells) if c % 2]
    if uneven and len(grid.axes) > 1:
        raise ValueError("on several axes the numbers of cells must be even")
    half = Grid(grid.block, grid.axes, tuple(c // 2 for c in grid.cells), grid.spacing)
    coarse = prolong(inject(df.select(*grid.block, *grid.axes, u), grid), half, u, order).withColumnRenamed(u, "__predicted")
    odd = None
    for a in grid.axes:
        odd = F.col(a) % 2 == 1 if odd is None else odd | (F.col(a) % 2 == 1)
    if not uneven:
        joined = df.join(coarse, [*grid.block, *grid.axes])
    else:
        w = grid.window(0)
        last = total([F.lit(float(x)) * F.lag(u, 2 * k + 1).over(w) for k, x in enumerate(K.beyond(order + 2))])
        joined = df.withColumn("__last", last).join(coarse, [*grid.block, *grid.axes], "left")
        joined = joined.withColumn("__predicted", F.when(F.col(grid.axes[0]) == grid.cells[0], F.col("__last")).otherwise(F.col("__predicted"))).drop("__last")
    return joined.withColumn("detail", F.when(odd, F.col("__predicted") - F.col(u)).otherwise(F.lit(0.0))).drop("__predicted")


def euler_step(df: DataFrame, grid: Grid, u: str, rate: Callable[[Engine], Column], h: float, order: int = 4) -> DataFrame:
    """``u + h * rate(u)``."""
    engine = Engine(df, grid, order)
    new = F.col(u) + F.lit(h) * rate(engine)
    return engine.df.withColumn(u, new).drop(*engine.staged)


def rk4_step(df: DataFrame, grid: Grid, u: str, rate: Callable[[Engine, str], Column], h: float, order: int = 4, fill: Callable[[DataFrame], DataFrame] | None = None, amplitude: float = 0.0) -> DataFrame:
    """One classical Runge-Kutta step; ``rate(engine, column)``. ``fill`` renews ghosts before each stage.

    With an ``amplitude``, ghosts are renewed once more and a filter of order 6 is added, not scaled by the step.
    """
    names, x = [], df.withColumn("__s", F.col(u))
    for k, (c, w) in enumerate(((0.0, 1 / 6), (0.5, 1 / 3), (0.5, 1 / 3), (1.0, 1 / 6))):
        if k:
            x = x.withColumn("__s", F.col(u) + F.lit(c * h) * F.col(f"__k{k - 1}"))
        if fill:
            x = fill(x)
        engine = Engine(x, grid, order)
        r = rate(engine, "__s")
        x = engine.df.withColumn(f"__k{k}", r).drop(*engine.staged)
        names.append((f"__k{k}", w))
    new = F.col(u) + F.lit(h) * total([F.lit(w) * F.col(n) for n, w in names])
    x = x.withColumn(u, new).drop("__s", *[n for n, _ in names])
    return dissipate(fill(x) if fill else x, grid, u, amplitude) if amplitude else x


def trapezoid_weight(grid: Grid) -> Column:
    """Half for each axis on which the node lies on a face of its block."""
    out = F.lit(1.0)
    for a, n in zip(grid.axes, grid.cells, strict=True):
        out = out * F.when((F.col(a) == 0) | (F.col(a) == n), F.lit(0.5)).otherwise(F.lit(1.0))
    return out


def inside(grid: Grid) -> Column:
    """Not a ghost."""
    out = F.lit(True)
    for a, n in zip(grid.axes, grid.cells, strict=True):
        out = out & F.col(a).between(0, n)
    return out


def l2_norm(df: DataFrame, grid: Grid, u: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Square root of the trapezoid sum of squares over all blocks, or for each value of ``by``."""
    h = 1.0
    for s in grid.spacing:
        h *= s
    return df.filter(inside(grid)).groupBy(*by).agg(F.sqrt(F.sum(F.col(u) * F.col(u) * trapezoid_weight(grid)) * F.lit(h)).alias("l2"))


def max_norm(df: DataFrame, grid: Grid, u: str, by: tuple[str, ...] = (), signed: bool = True) -> DataFrame:
    """The signed maximum, not below 0; with ``signed=False`` the largest absolute value."""
    v = F.col(u) if signed else F.abs(F.col(u))
    return df.filter(inside(grid)).groupBy(*by).agg(F.greatest(F.max(v), F.lit(0.0)).alias("max_norm" if signed else "linf"))


def oscillation(df: DataFrame, grid: Grid, u: str | list[str], width: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum over cells of ``width`` nodes, the last one may be shorter, of (max - min) over the cell's closed node set.

    The largest of several channels' sums, if ``u`` is a list.
    """
    channels = [u] if isinstance(u, str) else u
    x = df.filter(inside(grid))
    names = []
    for a, n in zip(grid.axes, grid.cells, strict=True):
        count = -(-n // width)
        own, before = F.floor(F.col(a) / width), F.floor((F.col(a) - 1) / width)
        cells = F.array_distinct(F.filter(F.array(own, before), lambda c: (c >= 0) & (c < count)))  # noqa: B023
        x = x.withColumn(f"__c{a}", F.explode(cells))
        names.append(f"__c{a}")
    cell = x.groupBy(*dict.fromkeys([*grid.block, *by]), *names).agg(*[(F.max(c) - F.min(c)).alias(f"__o{k}") for k, c in enumerate(channels)])
    sums = [F.sum(f"__o{k}") for k in range(len(channels))]
    return cell.groupBy(*by).agg((F.greatest(*sums) if len(sums) > 1 else sums[0]).alias("oscillation"))


def bottom_left(df: DataFrame, grid: Grid, u: str) -> DataFrame:
    """The value at vertex 0 of every block."""
    keep = F.lit(True)
    for a in grid.axes:
        keep = keep & (F.col(a) == 0)
    return df.filter(keep).select(*grid.block, u)
