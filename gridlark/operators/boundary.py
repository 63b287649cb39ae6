"""Ghost nodes and boundary terms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import weights as K
from .stencil import Grid, apply_axis

GHOST_KINDS = ("symmetric", "antisymmetric", "custom")
ONE_SIDED_KINDS = ("radiative", "free", "strong_dirichlet", "weak_dirichlet")


def kind_class(kind: str) -> str:
    """The first three kinds need ghost nodes, the others one-sided stencils."""
    if kind in GHOST_KINDS:
        return "ghost"
    if kind in ONE_SIDED_KINDS:
        return "one_sided"
    raise ValueError(f"no boundary kind {kind}")


@dataclass(frozen=True)
class Face:
    """A rule for one face of one channel; the target is a number, or a function of a node's place."""

    kind: str = "free"
    target: float | Callable[..., Column] = 0.0
    speed: float = 1.0
    strength: float = 1.0


def target_at(rule: Face, *place: Column) -> Column:
    return rule.target(*place) if callable(rule.target) else F.lit(rule.target)


Rules = dict[tuple[int, int], Face]  # (axis, 0 for the lower and 1 for the upper side)


def check_compatible(rules: Rules, classes: dict[tuple[int, int], str]) -> None:
    for face, rule in rules.items():
        if kind_class(rule.kind) != classes[face]:
            raise ValueError(f"face {face} is {classes[face]}; {rule.kind} is {kind_class(rule.kind)}")


def fill_physical(df: DataFrame, grid: Grid, u: str, rules: Rules, extent: int) -> DataFrame:
    """Sets face values (zero for odd parity, the target for strong Dirichlet), then mirrors the ghosts.

    A ghost ``-k`` or ``n + k`` takes the value at ``k`` or ``n - k``, with the product of the signs of the
    parity faces it lies beyond. Directions without a parity face get no ghosts.
    """
    x = df.select(*grid.block, *grid.axes, u)
    place = [grid.position(a) for a in range(len(grid.axes))]
    for (axis, side), rule in rules.items():
        at = grid.cells[axis] if side else 0
        if rule.kind in ("antisymmetric", "strong_dirichlet"):
            x = x.withColumn(u, F.when(F.col(grid.axes[axis]) == at, F.lit(0.0) if rule.kind == "antisymmetric" else target_at(rule, *place)).otherwise(F.col(u)))
    for axis, name in enumerate(grid.axes):
        i, n = F.col(name), grid.cells[axis]
        copies = [F.struct(i.cast("int").alias("i"), F.lit(1.0).alias("s"))]
        out = F.array(*copies)
        for side in (0, 1):
            rule = rules.get((axis, side))
            if rule is None or rule.kind not in ("symmetric", "antisymmetric"):
                continue
            sign = F.lit(1.0 if rule.kind == "symmetric" else -1.0)
            mirrored = F.struct(((2 * n - i) if side else -i).cast("int").alias("i"), sign.alias("s"))
            near = i.between(n - extent, n - 1) if side else i.between(1, extent)
            out = F.concat(out, F.when(near, F.array(mirrored)).otherwise(F.slice(F.array(mirrored), 1, 0)))
        x = x.withColumn("__c", F.explode(out)).withColumn(name, F.col("__c.i")).withColumn(u, F.col("__c.s") * F.col(u)).drop("__c")
    return x


def fill_direct(df: DataFrame, block: str, axis: str, cells: int, u: str, extent: int) -> DataFrame:
    """Ghosts of 1-D blocks in a row, copied from the neighbours at the same level, which share face nodes."""
    i, b = F.col(axis), F.col(block)
    own = F.array(F.struct(b.cast("long").alias("b"), i.cast("int").alias("i")))
    none = F.slice(own, 1, 0)
    left = F.when(i.between(1, extent), F.array(F.struct((b - 1).cast("long").alias("b"), (i + cells).cast("int").alias("i")))).otherwise(none)
    right = F.when(i.between(cells - extent, cells - 1), F.array(F.struct((b + 1).cast("long").alias("b"), (i - cells).cast("int").alias("i")))).otherwise(none)
    rest = [c for c in df.columns if c not in (block, axis, u)]
    spread = df.withColumn("__g", F.explode(F.concat(own, left, right)))
    return spread.select(*rest, F.col("__g.b").alias(block), F.col("__g.i").alias(axis), u)


def weak_dirichlet(rate: Column, u: Column, at_face: Column, rule: Face, *place: Column) -> Column:
    """On the face, the rate pulls towards the target."""
    return F.when(at_face, F.lit(rule.strength) * (target_at(rule, *place) - u)).otherwise(rate)


def sommerfeld(df: DataFrame, grid: Grid, u: str, rate: str, rule: Face, order: int = 4) -> DataFrame:
    """Radiative rates on the upper face of a 1-D grid, with the correction ``k / r^3`` fitted one node inside.

    ``df`` has the interior rates in ``rate``; positions are distances from the origin.
    """
    x, n = grid.position(0), grid.cells[0]
    name = grid.axes[0]
    slope = apply_axis(grid, K.derivative(order), 0, u)
    staged = df.withColumn("__adv", F.lit(rule.speed) * (F.col(u) - target_at(rule, x) + x * slope))
    w = grid.window(0)
    r_in = x - F.lit(grid.spacing[0])
    k = r_in * r_in * r_in * (F.lag(rate, 1).over(w) + F.lag("__adv", 1).over(w) / r_in)
    return staged.withColumn(rate, F.when(F.col(name) == n, -F.col("__adv") / x + k / (x * x * x)).otherwise(F.col(rate))).drop("__adv")
