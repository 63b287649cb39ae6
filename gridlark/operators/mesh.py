"""Node tables on uneven trees: flags, regridding, and values passed between levels.

Every leaf is a block of ``width`` cells on each axis. Nodes are rows (path, i, j, u) with i and j from 0 to
``width``, and beyond for ghosts. A node's place on the lattice of its level is ``cell * width + i``, so what a
neighbour holds at the same level, a level below or a level above follows from whole numbers, and every exchange
is an equi-join on (path, i, j). Neighbours must be within one level (:func:`balanced`).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import elements as E
from ..functions import weights as K
from ..functions.geometry import both
from . import tree as T
from .boundary import Rules, kind_class, target_at
from .settled import settled


def balanced(leaves: DataFrame, deepest: int) -> DataFrame:
    """Leaves of the least tree that divides at least as much, with touching leaves within one level.

    Where a cell is divided its neighbours must exist, so their parents are divided; from the deepest level up, one
    pass over the levels is enough and needs no join.
    """
    divided = leaves.filter(F.length("path") > 0).select(F.explode(T.prefixes(F.expr("substring(path, 1, length(path) - 1)"))).alias("path")).distinct()
    for level in range(deepest - 1, 0, -1):
        around = T.steps(divided.filter(F.length("path") == level)).filter("to is not null").select(T.parent(F.col("to")).alias("path"))
        divided = settled(divided.union(around).distinct())
    kids = divided.select(F.explode(F.array(*[F.concat("path", F.lit(str(d))) for d in range(1 << T.DIMS)])).alias("path"))
    root = leaves.sparkSession.createDataFrame([("",)], "path string")
    return kids.union(root).join(divided, "path", "left_anti")


def center(path: Column, axis: int) -> Column:
    low, high = T.bounds_of(path)[axis]
    return (low + high) / 2


def innermost(leaves: DataFrame) -> DataFrame:
    """``flag``: the leaf whose centre is lowest on axis 0, the first in Z-order of several."""
    first = leaves.agg(F.min(F.struct(center(F.col("path"), 0).alias("x"), "path")).alias("m")).select(F.col("m.path").alias("m_path"))
    return leaves.join(F.broadcast(first), F.col("path") == F.col("m_path"), "left").withColumn("flag", F.col("m_path").isNotNull()).drop("m_path")  # one row


def flags_in_radius(leaves: DataFrame, radius: float, level: int) -> DataFrame:
    """``refine`` and ``coarsen``: leaves inside a radius on axis 0 go one level towards ``level``."""
    near, own = center(F.col("path"), 0) < radius, F.length("path")
    return leaves.withColumn("refine", near & (own < level)).withColumn("coarsen", near & (own > level))


def limited(leaves: DataFrame, lowest: int, highest: int) -> DataFrame:
    """No refinement from level ``highest`` on, no coarsening up to level ``lowest``."""
    own = F.length("path")
    return leaves.withColumn("refine", F.col("refine") & (own < highest)).withColumn("coarsen", F.col("coarsen") & (own > lowest))


def buffered(leaves: DataFrame, count: int, flag: str = "refine") -> DataFrame:
    """Flags spread to all touching leaves, ``count`` times; each round starts from the flags of the one before."""
    edges = settled(T.all_neighbors(leaves).select("path", "neighbor").distinct())
    on = leaves.filter(F.col(flag)).select("path")
    for _ in range(count):
        on = settled(on.union(edges.join(on, "path").select(F.col("neighbor").alias("path"))).distinct())
    return leaves.join(on.withColumn("__on", F.lit(True)), "path", "left").withColumn(flag, F.coalesce("__on", F.lit(False))).drop("__on")


def flag_counts(leaves: DataFrame) -> DataFrame:
    """Leaves flagged for each change, and whether any is."""
    r, c = F.count_if(F.col("refine")), F.count_if(F.col("coarsen"))
    return leaves.agg(r.alias("n_refine"), c.alias("n_coarsen"), ((r + c) > 0).alias("needed"))


def unfit_to_coarsen(leaves: DataFrame, edges: DataFrame, flag: str = "coarsen") -> DataFrame:
    """Flagged leaves whose siblings are not all flagged leaves, or that have a finer neighbour without a flag."""
    whole = T.complete_siblings(leaves.select("path", F.col(flag).alias("flag"))).filter("flag").select("path")
    alone = leaves.filter(F.col(flag)).select("path").join(whole, "path", "left_anti")
    plain = leaves.filter(~F.col(flag)).select("path")
    beside = edges.join(plain, "path").select(F.col("neighbor").alias("path"))
    return alone.union(leaves.filter(F.col(flag)).select("path").join(beside, "path", "left_semi")).distinct()


def balance_flags(leaves: DataFrame, levels: int) -> DataFrame:
    """``refine`` and ``coarsen`` such that the new tree is balanced; refinement wins over coarsening beside it."""
    edges = settled(T.coarse_edges(leaves))
    x = T.balance_refine(leaves, edges, levels, "refine")
    refined = x.filter("refine").select("path")
    same = T.all_neighbors(leaves).filter(F.length("neighbor") <= F.length("path")).select("path", "neighbor")
    beside = same.join(refined, "path").select(F.col("neighbor").alias("path")).union(refined).distinct().withColumn("__no", F.lit(True))
    x = settled(x.join(beside, "path", "left").withColumn("coarsen", F.col("coarsen") & F.col("__no").isNull()).drop("__no"))
    return T.balance_coarsen(x, edges, levels, "coarsen")


def regrid(leaves: DataFrame) -> DataFrame:
    """(path, change, new): each old leaf with the new leaves that take its place; ``change`` is refine, coarsen or keep."""
    kids = F.array(*[F.concat("path", F.lit(str(d))) for d in range(1 << T.DIMS)])
    new = F.when(F.col("refine"), kids).when(F.col("coarsen"), F.array(T.parent(F.col("path")))).otherwise(F.array("path"))
    change = F.when(F.col("refine"), "refine").when(F.col("coarsen"), "coarsen").otherwise("keep")
    return leaves.select("path", change.alias("change"), F.explode(new).alias("new"))


def boundary_regions(leaves: DataFrame) -> DataFrame:
    """(path, region, crossed): for each direction, the direction in which the step leaves the domain; 4 if it does not."""
    n = F.pow(F.lit(2.0), F.length("path")).cast("int") - 1
    x = leaves.select("path", *[T.cell_of(F.col("path"), a).alias(f"c{a}") for a in range(T.DIMS)], n.alias("n")).withColumn("region", F.explode(F.sequence(F.lit(0), F.lit(3**T.DIMS - 1))))
    crossed = F.lit(0)
    for a in range(T.DIMS):
        s = F.floor(F.col("region") / 3**a) % 3
        out = F.when((s == 0) & (F.col(f"c{a}") == 0), 0).when((s == 2) & (F.col(f"c{a}") == F.col("n")), 2).otherwise(1)
        crossed = crossed + out * 3**a
    return x.select("path", "region", crossed.cast("int").alias("crossed"))


def nodes_of(leaves: DataFrame, width: int) -> DataFrame:
    """(path, i, j) of all nodes of all leaves, without ghosts."""
    every = F.sequence(F.lit(0), F.lit(width))
    return leaves.select("path", F.explode(every).alias("i")).select("path", "i", F.explode(every).alias("j"))


def position(axis: int, width: int) -> Column:
    """Where a node lies on an axis of the unit box."""
    return (T.cell_of(F.col("path"), axis) + F.col("ij"[axis]) / float(width)) * F.pow(F.lit(2.0), -F.length("path"))


def spacing(leaves: DataFrame, width: int) -> DataFrame:
    """(path, h) and the least spacing of the mesh."""
    h = F.pow(F.lit(2.0), -F.length("path")) / float(width)
    finest = leaves.agg((F.pow(F.lit(2.0), -F.max(F.length("path"))) / float(width)).alias("finest"))
    return leaves.select("path", h.alias("h")).join(F.broadcast(finest), F.lit(True))  # one row


def spacing_of_vertices(leaves: DataFrame, width: int) -> DataFrame:
    """(path, i, j, h): a leaf's spacing, and half of it on faces beyond which leaves are finer."""
    finer = T.all_neighbors(leaves).filter((F.length("neighbor") > F.length("path")) & F.col("region").isin(1, 3, 5, 7))
    per = finer.groupBy("path").agg(F.collect_set("region").alias("faces"))
    x = nodes_of(leaves, width).join(per, "path", "left")
    on = F.lit(False)
    for region, at in ((3, F.col("i") == 0), (5, F.col("i") == width), (1, F.col("j") == 0), (7, F.col("j") == width)):
        on = on | (at & F.coalesce(F.array_contains("faces", region), F.lit(False)))
    h = F.pow(F.lit(2.0), -F.length("path")) / float(width)
    return x.select("path", "i", "j", F.when(on, h / 2).otherwise(h).alias("h"))


def boundary_classes(leaves: DataFrame, one_sided: tuple[int, ...] = ()) -> DataFrame:
    """(path, face, class): ``one_sided`` on the domain's faces that are so, ``ghost`` on all others; and whether the leaf has none of the first."""
    on = T.boundary_faces(leaves).filter(F.col("face").isin(*one_sided)) if one_sided else T.boundary_faces(leaves).limit(0)
    every = leaves.select("path", F.explode(F.sequence(F.lit(0), F.lit(2 * T.DIMS - 1))).alias("face"))
    x = every.join(on.withColumn("__on", F.lit(True)), ["path", "face"], "left").withColumn("class", F.when(F.col("__on"), "one_sided").otherwise("ghost"))
    free = on.select("path").distinct().withColumn("__free", F.lit(True))
    return x.join(free, "path", "left").select("path", "face", "class", F.col("__free").isNull().alias("interior"))


def half_steps(order: int, width: int) -> Column:
    """For each half step 0 .. 2 * width along a block: the side beyond which its centred row reads (1: none), and (first node, weights) of the centred and of the one-sided row."""
    if width <= order:
        raise ValueError("the width must be above the order")
    kernel = K.interpolation(order)
    offsets, half = sorted(kernel.interior), len(kernel.left)
    row = lambda first, w: f"named_struct('first', {first}, 'w', array({', '.join(f'{x!r}D' for x in w)}))"
    out = []
    for x in range(2 * width + 1):
        p, side = x // 2, 1
        centred = (p, [1.0]) if x % 2 == 0 else (p + offsets[0], [kernel.interior[o] for o in offsets])
        edge = centred
        if x % 2 and p < half:
            side, edge = 0, (0, kernel.left[p])
        elif x % 2 and width - 1 - p < half:
            mirrored = kernel.left[width - 1 - p][::-1]
            side, edge = 2, (width + 1 - len(mirrored), mirrored)
        out.append(f"named_struct('side', {side}, 'rows', array({row(*centred)}, {row(*edge)}))")
    return F.expr(f"array({', '.join(out)})")


def held(nodes: DataFrame, sources: DataFrame, width: int, ghosts: int, u: str) -> DataFrame:
    """(source, v): the nodes of each leaf in ``sources`` (path) as one array, axis 0 fastest, with ``ghosts`` around it."""
    on = F.col("i").between(-ghosts, width + ghosts) & F.col("j").between(-ghosts, width + ghosts)
    x = nodes.filter(on).select("path", "i", "j", F.col(u).cast("double").alias("u")).join(sources.select("path").distinct(), "path", "left_semi")
    v = F.transform(F.array_sort(F.collect_list(F.struct("j", "i", "u"))), lambda c: c["u"])  # as many as a leaf has nodes
    x = x.groupBy(F.col("path").alias("source")).agg(v.alias("v"))
    whole = F.size("v") == (width + 1 + 2 * ghosts) ** 2
    return x.withColumn("v", F.when(whole, F.col("v")).otherwise(F.raise_error(F.lit("a leaf has missing or repeated nodes"))))


def prolonged(pairs: DataFrame, sources: DataFrame, width: int, ghosts: int, u: str, order: int) -> DataFrame:
    """(path, i, j, u) of all nodes in the boxes of ``pairs``, interpolated in their source.

    pairs: (path, source, ok) and for each axis a ``lo``, ``hi`` and ``off``: node i is half step ``i + off`` of the source.
    ``ok`` says for each direction whether the source has ghosts there. A row is centred where it has what that
    reads, else one-sided. The join has one row for each pair of leaves, and its nodes are contracted in arrays.
    """
    n, table = width + 1 + 2 * ghosts, half_steps(order, width)
    x = pairs.join(sources, "source")
    for a in range(T.DIMS):
        places = F.sequence(F.col(f"lo{a}"), F.col(f"hi{a}"))
        x = x.withColumn(f"__r{a}", F.transform(places, lambda k: F.struct(k.alias("k"), F.element_at(table, k + F.col(f"off{a}") + 1).alias("t"))))  # noqa: B023
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)

    def value(a: Column, b: Column) -> Column:
        s0, s1 = a["t"]["side"], b["t"]["side"]
        c0, c1, corner = F.col("ok")[s0 + 3], F.col("ok")[s1 * 3 + 1], F.col("ok")[s0 + 3 * s1]
        chosen = F.struct(a["t"]["rows"][F.when(c0 & (corner | ~c1), 0).otherwise(1)].alias("a"), b["t"]["rows"][F.when(c1 & (corner | ~c0), 0).otherwise(1)].alias("b"))

        def contracted(r: Column) -> Column:
            at = lambda k: (r["b"]["first"] + k + ghosts) * n + r["a"]["first"] + ghosts + 1
            return add(F.transform(r["b"]["w"], lambda w, k: w * add(F.zip_with(F.slice(F.col("v"), at(k), F.size(r["a"]["w"])), r["a"]["w"], lambda p, q: p * q))))

        return F.transform(F.array(chosen), contracted)[0]

    every = F.flatten(F.transform("__r1", lambda b: F.transform("__r0", lambda a: F.struct(a["k"].alias("i"), b["k"].alias("j"), value(a, b).alias(u)))))
    return x.select("path", F.explode(every).alias("__n")).select("path", "__n.i", "__n.j", f"__n.{u}")


def parity_faces(rules: Rules) -> set[tuple[int, int]]:
    return {face for face, rule in rules.items() if rule.kind in ("symmetric", "antisymmetric")}


def open_sides(s: DataFrame, rules: Rules) -> DataFrame:
    """(path, ok): for each direction whether the ghosts there come from leaves as fine or finer, or mirror such; true for the leaf itself.

    s: each leaf's steps (path, region, to) with the ``neighbor`` of the same or a coarser level, if there is one.
    """
    near = F.col("to").isNotNull() & (F.col("neighbor").isNull() | (F.length("neighbor") == F.length("path")))
    own = F.struct(F.lit(3**T.DIMS // 2).alias("region"), F.lit(True).alias("ok"))
    x = s.groupBy("path").agg(F.array_sort(F.concat(F.collect_list(F.struct("region", near.alias("ok"))), F.array(own))).alias("__s"))
    x = x.select("path", "__s.ok", (F.pow(F.lit(2.0), F.length("path")) - 1).cast("int").alias("__last"), *[T.cell_of(F.col("path"), a).alias(f"__c{a}") for a in range(T.DIMS)])
    parity, out = parity_faces(rules), []
    for region in range(3**T.DIMS):
        inner, fit = F.lit(0), F.lit(True)
        for a in range(T.DIMS):
            side = region // 3**a % 3
            beyond = F.lit(False) if side == 1 else F.col(f"__c{a}") == (F.col("__last") if side else F.lit(0))
            inner = inner + F.when(beyond, 1).otherwise(side) * 3**a
            if (a, side // 2) not in parity:
                fit = fit & ~beyond
        out.append(fit & F.col("ok")[inner])
    return x.select("path", F.array(*out).alias("ok"))


def with_faces(x: DataFrame, width: int, extent: int, u: str, rules: Rules) -> DataFrame:
    """Nodes on strong Dirichlet faces set to their target, on odd ones to 0, and ghosts mirrored beyond parity faces."""
    level = F.length("path")
    for (axis, side), rule in sorted(rules.items()):
        if rule.kind not in ("symmetric", "antisymmetric", "strong_dirichlet"):
            continue  # rates obey these, or the caller fills them
        name, sign = "ij"[axis], 1.0 if rule.kind == "symmetric" else -1.0
        k, c = F.col(name), T.cell_of(F.col("path"), axis)
        at_edge = c == (F.pow(F.lit(2.0), level).cast("int") - 1 if side else F.lit(0))
        on_face = at_edge & (k == (width if side else 0))
        if rule.kind == "strong_dirichlet":
            x = x.withColumn(u, F.when(on_face, target_at(rule, position(0, width), position(1, width))).otherwise(F.col(u)))
            continue
        if sign < 0:
            x = x.withColumn(u, F.when(on_face, F.lit(0.0)).otherwise(F.col(u)))
        near = k.between(width - extent, width - 1) if side else k.between(1, extent)
        mirrored = x.filter(at_edge & near).withColumn(name, 2 * width - k if side else -k).withColumn(u, F.lit(sign) * F.col(u))
        x = x.unionByName(mirrored.select(*x.columns))
    return x


def fill_boundary(nodes: DataFrame, leaves: DataFrame, width: int, extent: int, u: str = "u", order: int = 4, rules: Rules | None = None, *, through_faces: bool = False) -> DataFrame:
    """``nodes`` with ``extent`` ghosts around every leaf.

    First ghosts copy a neighbour of the same level or take every second node of a finer one, and faces of the domain are
    set and, with ``through_faces``, mirrored, so that interpolation beside them is centred too; else it is one-sided there,
    which is right for fields that their face bends. Then ghosts beside a coarser leaf are interpolated in it, centred on the ghosts that it has by now;
    on sides where itself it would need a coarser leaf, or has no ghosts, rows are one-sided, so that no value waits for
    another level. Then faces are set again. Beyond the domain ghosts mirror with the parity of their face, if it has
    one. Nodes on strong Dirichlet faces take the target; other one-sided kinds change no values.
    """
    rules = rules or {}
    for rule in rules.values():
        kind_class(rule.kind)  # an unknown one is an error
    reach = max(extent, order // 2)  # what centred rows read
    box = {a: [(F.lit(-reach), F.lit(-1)), (F.lit(0), F.lit(width)), (F.lit(width + 1), F.lit(width + reach))] for a in range(T.DIMS)}
    around = T.steps(leaves).join(T.coarser_neighbors(leaves), ["path", "region"], "left")
    s = around.filter("to is not null")
    for a in range(T.DIMS):
        side = F.floor(F.col("region") / 3**a) % 3
        for name, end in (("lo", 0), ("hi", 1)):
            s = s.withColumn(f"{name}{a}", F.when(side == 0, box[a][0][end]).when(side == 1, box[a][1][end]).otherwise(box[a][2][end]))
        s = s.withColumn(f"c{a}", T.cell_of(F.col("path"), a)).withColumn(f"t{a}", T.cell_of(F.coalesce("neighbor", "to"), a))
    level, other = F.length("path"), F.length("neighbor")
    t = s.filter("neighbor is null or length(neighbor) = length(path)")
    for a, n in enumerate("ij"):
        t = t.withColumn(n, F.explode(F.sequence(F.col(f"lo{a}"), F.col(f"hi{a}")))).withColumn(f"g{n}", F.col(f"c{a}") * width + F.col(n))  # on the lattice of the level
    direct = t.filter(other == level).select("path", "i", "j", F.col("neighbor").alias("source"), *[(F.col(f"g{n}") - F.col(f"t{a}") * width).alias(f"s{n}") for a, n in enumerate("ij")])
    cells = [F.least(F.greatest(F.floor(2 * F.col(f"g{n}") / width), 2 * F.col(f"t{a}")), 2 * F.col(f"t{a}") + 1).cast("int") for a, n in enumerate("ij")]
    fine = t.filter("neighbor is null").select("path", "i", "j", T.path_of(cells, level + 1).alias("source"), *[(2 * F.col(f"g{n}") - c * width).alias(f"s{n}") for c, n in zip(cells, "ij", strict=True)])
    x = nodes.select("path", "i", "j", u)
    copied = direct.unionByName(fine).join(x.select(F.col("path").alias("source"), F.col("i").alias("si"), F.col("j").alias("sj"), u), ["source", "si", "sj"]).select("path", "i", "j", u)
    first = x.unionByName(copied)
    coarse = s.filter(other < level).withColumnRenamed("neighbor", "source")
    for a in range(T.DIMS):
        low = F.greatest(F.col(f"lo{a}"), F.lit(-extent))
        coarse = coarse.withColumn(f"lo{a}", low).withColumn(f"hi{a}", F.least(F.col(f"hi{a}"), F.lit(width + extent))).withColumn(f"off{a}", (F.col(f"c{a}") - 2 * F.col(f"t{a}")) * width)
    early = rules if through_faces else {face: rule for face, rule in rules.items() if face not in parity_faces(rules)}
    sides = open_sides(around, early)
    gaps = sides.select("path", F.posexplode("ok").alias("region", "__ok")).filter(~F.col("__ok"))
    for a, n in enumerate("ij"):
        side = F.floor(F.col("region") / 3**a) % 3
        ends = [F.when(side == 0, box[a][0][e]).when(side == 1, box[a][1][e]).otherwise(box[a][2][e]) for e in (0, 1)]
        gaps = gaps.withColumn(n, F.explode(F.sequence(*ends)))
    known = with_faces(first, width, reach, u, early).unionByName(gaps.select("path", "i", "j", F.lit(None).cast("double").alias(u)))
    sources = held(known, coarse.select(F.col("source").alias("path")), width, reach, u)
    pairs = coarse.join(sides.withColumnRenamed("path", "source"), "source").select("path", "source", "ok", *[f"{k}{a}" for k in ("lo", "hi", "off") for a in range(T.DIMS)])
    on = F.col("i").between(-extent, width + extent) & F.col("j").between(-extent, width + extent)
    return with_faces(first.filter(on).unionByName(prolonged(pairs, sources, width, reach, u, order)), width, extent, u, rules)


def transfer(nodes: DataFrame, changes: DataFrame, width: int, u: str = "u", order: int = 4) -> DataFrame:
    """Values on the new leaves of :func:`regrid`: copied, interpolated for halves, every second node for parents."""
    x = nodes.select("path", "i", "j", u)
    kept = x.join(changes.filter("change = 'keep'").select("path"), "path").select("path", "i", "j", u)
    last = F.expr("substring(path, length(path), 1)").cast("int")
    bits = [F.floor(last / (1 << a)).cast("int") % 2 for a in range(T.DIMS)]
    even = (F.col("i") % 2 == 0) & (F.col("j") % 2 == 0)
    once = ~((bits[0] == 1) & (F.col("i") == 0)) & ~((bits[1] == 1) & (F.col("j") == 0))  # a node that siblings share comes from the first
    joined = x.join(changes.filter("change = 'coarsen'").select("path", "new"), "path").filter(even & once)
    parents = joined.select(F.col("new").alias("path"), *[F.floor((F.col(n) + bits[a] * width) / 2).cast("int").alias(n) for a, n in enumerate("ij")], u)
    refined = changes.filter("change = 'refine'")
    pairs = refined.select(F.col("new").alias("path"), F.col("path").alias("source"))
    ends = [c for a in range(T.DIMS) for c in (F.lit(0).alias(f"lo{a}"), F.lit(width).alias(f"hi{a}"), (bits[a] * width).alias(f"off{a}"))]
    alone = F.array(*[F.lit(r == 3**T.DIMS // 2) for r in range(3**T.DIMS)])
    halves = prolonged(pairs.select("path", "source", alone.alias("ok"), *ends), held(x, refined, width, 0, u), width, 0, u, order)
    return kept.unionByName(parents).unionByName(halves)


def exchange_boxes(leaves: DataFrame, width: int, ghost: int) -> DataFrame:
    """(path, region, neighbor, kind, d0, n0, s0, d1, n1, s1): the nodes that each touching leaf fills.

    On each axis ``n`` nodes from ``d`` on are filled, from the neighbour's node ``s`` on; for a coarser neighbour ``s``
    counts half steps, for a finer one every second node. Shared faces belong to the box, unless the neighbour is finer.
    """
    s = T.steps(leaves).filter("to is not null").join(T.coarser_neighbors(leaves), ["path", "region"], "left")
    sides = [F.floor(F.col("region") / 3**a) % 3 for a in range(T.DIMS)]
    every = F.array(*[F.lit(str(d)) for d in range(1 << T.DIMS)])
    facing = F.filter(every, lambda d: both([(x == 1) | ((F.floor(d.cast("int") / (1 << a)) % 2 == 1) == (x == 0)) for a, x in enumerate(sides)]))
    halves = F.transform(facing, lambda d: F.concat("to", d))
    s = s.withColumn("neighbor", F.explode(F.when(F.col("neighbor").isNull(), halves).otherwise(F.array("neighbor"))))
    step = F.length("neighbor") - F.length("path")
    kind = F.when(step == 0, "direct").when(step == 1, "fine").otherwise("coarse")
    fine = step == 1
    boxes = []
    for a in range(T.DIMS):
        own, other, at = T.cell_of(F.col("path"), a), T.cell_of(F.col("neighbor"), a), sides[a]
        upper_half = fine & (other % 2 == 1)
        low = F.when(at == 0, -ghost).when(at == 2, F.when(fine, width + 1).otherwise(width)).otherwise(F.when(upper_half, width // 2).otherwise(0))
        high = F.when(at == 0, F.when(fine, -1).otherwise(0)).when(at == 2, width + ghost).otherwise(F.when(fine & ~upper_half, width // 2).otherwise(width))
        corner = F.when(fine, other * (width // 2)).when(step == 0, other * width).otherwise(2 * other * width)
        boxes += [low.alias(f"d{a}"), (high - low + 1).alias(f"n{a}"), (own * width + low - corner).cast("int").alias(f"s{a}")]
    return s.select("path", "region", "neighbor", kind.alias("kind"), *boxes)


def values_at(points: DataFrame, nodes: DataFrame, leaves: DataFrame, width: int, u: str = "u", order: int | None = None) -> DataFrame:
    """``points`` (x and y in the unit box, ``path`` at the deepest level) with their leaf and the value there.

    The polynomial through all nodes of the leaf is evaluated; with an ``order`` below the width the one of that order on each
    axis that comes nearest to them, by least squares. A leaf's nodes travel as one array of
    ``(width + 1) ** 2`` values, so the join has one row for each point.
    """
    n = width + 1
    held = nodes.filter(F.col("i").between(0, width) & F.col("j").between(0, width)).groupBy(F.col("path").alias("leaf"))
    held = held.agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "i", u))), lambda v: v[u]).alias("__v"))  # as many as a leaf has nodes
    x = T.locate(points, leaves)
    if order is not None and not 0 <= order <= width:
        raise ValueError("the order is at most the width")
    fit = None if order is None else np.linalg.pinv(E.monomials(order, E.uniform_points(n)))  # a row for each power

    def weights(axis: int) -> list[Column]:
        t = (F.col("xy"[axis]) * F.pow(F.lit(2.0), F.length("leaf")) - T.cell_of(F.col("leaf"), axis)) * float(width)
        out = []
        for k in range(n):
            if fit is not None:
                s, w = 2.0 * t / float(width) - 1.0, F.lit(0.0)
                for c in fit[::-1, k]:
                    w = w * s + F.lit(float(c))
                out.append(w)
                continue
            w = F.lit(1.0)
            for m in range(n):
                if m != k:
                    w = w * (t - float(m)) / float(k - m)
            out.append(w)
        return out

    x = x.withColumn("__a", F.array(*weights(0))).withColumn("__b", F.array(*weights(1))).join(held, "leaf")
    rows = F.transform(F.col("__b"), lambda w, j: w * F.aggregate(F.zip_with(F.slice("__v", j * n + 1, n), "__a", lambda v, a: v * a), F.lit(0.0), lambda s, v: s + v))
    return x.withColumn(u, F.aggregate(rows, F.lit(0.0), lambda s, v: s + v)).drop("__a", "__b", "__v")


def scaled_steps(nodes: DataFrame, leaves: DataFrame, width: int, u: str = "u") -> DataFrame:
    """Values times the spacing around their node over the least spacing: a step as long as each node allows."""
    finest = leaves.agg((F.pow(F.lit(2.0), -F.max(F.length("path"))) / float(width)).alias("__least"))
    x = nodes.join(spacing_of_vertices(leaves, width), ["path", "i", "j"]).join(F.broadcast(finest), F.lit(True))  # one row
    return x.withColumn(u, F.col(u) * F.col("h") / F.col("__least")).drop("h", "__least")


def node_owners(leaves: DataFrame, width: int, flag: str = "refine") -> DataFrame:
    """(path, i, j, cell, flag): each node's leaf by number, and the leaf's flag as a number."""
    x = T.numbered(leaves.select("path", F.col(flag).cast("int").alias("flag")), name="cell")
    return nodes_of(leaves, width).join(x, "path").select("path", "i", "j", "cell", "flag")


def interface_sources(leaves: DataFrame, width: int, ghost: int) -> DataFrame:
    """(path, i, j, region, neighbor, kind): the one leaf that each ghost or shared node is filled from.

    Where several boxes of :func:`exchange_boxes` hold a node, the coarsest neighbour fills it, then the lowest in Z-order,
    then the lowest direction. A node shared with leaves of the same level keeps its own value in the lowest of them.
    """
    x = exchange_boxes(leaves, width, ghost)
    for a, n in enumerate("ij"):
        x = x.withColumn(n, F.explode(F.sequence(F.col(f"d{a}"), F.col(f"d{a}") + F.col(f"n{a}") - 1)))
    best = x.groupBy("path", "i", "j").agg(F.min(F.struct(F.length("neighbor").alias("level"), "neighbor", "region", "kind")).alias("b")).select("path", "i", "j", "b.region", "b.neighbor", "b.kind")
    inside = F.col("i").between(0, width) & F.col("j").between(0, width)
    return best.filter(~((F.col("kind") == "direct") & (F.col("path") <= F.col("neighbor")) & inside))


def interface_fields(leaves: DataFrame, width: int, ghost: int) -> DataFrame:
    """(path, i, j, neighbor_id, interface_id) of all nodes and ghosts: the numbers of the leaf and of the box that fill them, -1 if none does.

    Leaves are numbered in Z-order, boxes by the texts of (path, region, neighbor).
    """
    cells = T.numbered(leaves.select("path"), name="neighbor_id").withColumnRenamed("path", "neighbor")
    key = F.concat_ws(" ", "path", "region", "neighbor")
    boxes = T.numbered(exchange_boxes(leaves, width, ghost).select("path", "region", "neighbor", key.alias("__key")), "__key", "interface_id").drop("__key")
    filled = interface_sources(leaves, width, ghost).join(boxes, ["path", "region", "neighbor"]).join(cells, "neighbor")
    every = F.sequence(F.lit(-ghost), F.lit(width + ghost))
    x = leaves.select("path", F.explode(every).alias("i")).select("path", "i", F.explode(every).alias("j"))
    none = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return x.join(filled, ["path", "i", "j"], "left").select("path", "i", "j", none("neighbor_id"), none("interface_id"))
