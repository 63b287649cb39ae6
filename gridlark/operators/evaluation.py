"""User functions at every node of an uneven mesh, with the rules of its boundary.

Ghosts come from neighbouring leaves of any level, so stencils are centred all over a leaf, except at faces of the domain
without ghosts, where they are one-sided. All stencils of a leaf share one shuffle by leaf, however many axes they run along.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import weights as K
from . import mesh as M
from . import tree as T
from .boundary import Face, Rules, kind_class, target_at
from .stencil import Engine, Grid, total

AXES = ("i", "j")


class MeshEngine(Engine):
    """What a user function may ask for; each channel has the edges that its own rules give."""

    def __init__(self, df: DataFrame, grids: dict[str, Grid], order: int):
        super().__init__(df, next(iter(grids.values())), order)
        self.grids = grids

    def _with(self, u: str, what: Callable[[], Column]) -> Column:
        self.grid = self.grids[u]
        return what()

    def derivative(self, u: str, axis: int) -> Column:
        return self._with(u, lambda: Engine.derivative(self, u, axis))

    def second_derivative(self, u: str, axis: int) -> Column:
        return self._with(u, lambda: Engine.second_derivative(self, u, axis))

    def mixed_derivative(self, u: str, a: int, b: int) -> Column:
        self.grids.setdefault(f"__d{a}_{u}", self.grids[u])
        return super().mixed_derivative(u, a, b)

    def dissipation(self, u: str, axis: int) -> Column:
        return self._with(u, lambda: Engine.dissipation(self, u, axis))


def one_sided_faces(rules: Rules) -> list[tuple[int, int]]:
    """The faces of the domain without ghosts: those without a rule, and those whose kind says so."""
    return [(a, s) for a in range(T.DIMS) for s in (0, 1) if (a, s) not in rules or kind_class(rules[a, s].kind) == "one_sided"]


def with_ghosts(nodes: DataFrame, leaves: DataFrame, width: int, extent: int, rules: Mapping[str, Rules], order: int) -> DataFrame:
    """All channels with their ghosts, and of each leaf its cell, the last cell of its level and its spacing."""
    filled = None
    for u, own in rules.items():
        one = M.fill_boundary(nodes, leaves, width, extent, u, order, own)
        filled = one if filled is None else filled.join(one, ["path", *AXES], "full")
    n = F.pow(F.lit(2.0), F.length("path"))
    place = leaves.select("path", *[T.cell_of(F.col("path"), a).alias(f"__c{a}") for a in range(T.DIMS)], (n - 1).cast("int").alias("__last"), (1 / n).alias("__size"))
    return filled.join(place, "path").repartition("path")


def on_faces(width: int) -> dict[tuple[int, int], Column]:
    """Whether a node lies on a face of the domain."""
    return {(a, s): (F.col(f"__c{a}") == (F.col("__last") if s else F.lit(0))) & (F.col(AXES[a]) == (width if s else 0)) for a in range(T.DIMS) for s in (0, 1)}


def owner(faces: list[tuple[int, int]], width: int) -> Column:
    """The one of these faces that a node belongs to, as ``2 * axis + side``: lower faces first, then lower axes; null off them."""
    at = on_faces(width)
    return F.coalesce(*[F.when(at[f], F.lit(2 * f[0] + f[1])) for f in sorted(faces, key=lambda f: (f[1], f[0]))], F.lit(None).cast("int"))


def apply(nodes: DataFrame, leaves: DataFrame, width: int, f: Callable[[Engine], dict[str, Column]], rules: Mapping[str, Rules], order: int = 4) -> DataFrame:
    """(path, i, j) of all nodes, and the columns that ``f`` returns.

    rules: the channels of ``nodes``, each with its faces' rules; a face without one is free. A column of ``f`` that is
    named like a channel is that channel's rate and obeys its rules: on weak Dirichlet faces it pulls towards the target, on
    radiative faces it is that of a wave that leaves, with the correction ``k / r ** 3`` fitted one node inside. A node where
    faces meet belongs to one of them. Nulls in a channel make what depends on them null.
    """
    extent = K.derivative(order).border
    df = with_ghosts(nodes, leaves, width, extent, rules, order)
    h = F.col("__size") / float(width)
    origin = tuple(F.col(f"__c{a}") * F.col("__size") for a in range(T.DIMS))
    grids = {}
    for u, own in rules.items():
        open_ = one_sided_faces(own)
        edge = lambda a, s: (F.col(f"__c{a}") == (F.col("__last") if s else F.lit(0))) if (a, s) in open_ else False  # noqa: B023, E731
        grids[u] = Grid(("path",), AXES, (width,) * T.DIMS, (h,) * T.DIMS, origin, tuple((edge(a, 0), edge(a, 1)) for a in range(T.DIMS)))
    engine = MeshEngine(df, grids, order)
    out = f(engine)
    done = engine.df.select("*", *[c.alias(f"__out_{k}") for k, c in out.items()])
    columns = {k: F.col(f"__out_{k}") for k in out}
    for u in [k for k in out if k in rules]:
        faces = {face: rule for face, rule in rules[u].items() if rule.kind in ("weak_dirichlet", "radiative")}
        if not faces:
            continue
        own = owner(one_sided_faces(rules[u]), width)
        done = done.withColumn(f"__own_{u}", own)
        place = [grids[u].position(a) for a in range(T.DIMS)]
        for (axis, side), rule in faces.items():
            here = F.col(f"__own_{u}") == 2 * axis + side
            if rule.kind == "weak_dirichlet":
                columns[u] = F.when(here, F.lit(rule.strength) * (target_at(rule, *place) - F.col(u))).otherwise(columns[u])
            else:
                done, rate = _leaving(done, engine, u, axis, side, rule)
                columns[u] = F.when(here, rate).otherwise(columns[u])
    inside = F.col("i").between(0, width) & F.col("j").between(0, width)
    return done.select("path", *AXES, *[c.alias(k) for k, c in columns.items()], inside.alias("__inside")).filter("__inside").drop("__inside")


def _leaving(done: DataFrame, engine: MeshEngine, u: str, axis: int, side: int, rule: Face) -> tuple[DataFrame, Column]:
    """The radiative rate of a face: the wave's own, and what is missing from it one node inside, which falls as ``r ** -3``."""
    grid, name = engine.grids[u], f"__leaving_{axis}{side}_{u}"
    x = [grid.position(a) for a in range(T.DIMS)]
    r = F.nullif(F.sqrt(total([p * p for p in x])), F.lit(0.0))
    wave = F.lit(rule.speed) * (F.col(u) - target_at(rule, *x) + total([p * engine.derivative(u, a) for a, p in enumerate(x)]))
    done = done.withColumn(name, F.struct(r.alias("r"), wave.alias("wave"), F.col(f"__out_{u}").alias("rate")))
    w = grid.window(axis)
    inner = F.lag(name, 1).over(w) if side else F.lead(name, 1).over(w)
    missing = inner["r"] * inner["r"] * inner["r"] * (inner["rate"] + inner["wave"] / inner["r"])
    own = F.col(name)
    return done, -own["wave"] / own["r"] + missing / (own["r"] * own["r"] * own["r"])
