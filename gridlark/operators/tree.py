"""Quadtrees (2^N-trees) as tables of leaves, keyed by their bit path.

A leaf is a string with one digit for each level, the half of its parent it lies in (axis 0 in the low bit).
Everything else follows from the path: level, lattice position, bounds, parents. Neighbours, location and
balancing are equi-joins on paths; no join compares boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .settled import settled

DIMS = 2


def lattice(x: Column, level: int) -> Column:
    """The cell of a coordinate in [0, 1] at a level; a point on a border belongs to the lower cell."""
    return F.greatest(F.least(F.ceil(x * float(1 << level)) - 1, F.lit((1 << level) - 1)), F.lit(0)).cast("int")


def path_of(cells: list[Column], level: Column | int) -> Column:
    """The path of a lattice position at a level."""
    level = F.lit(level) if isinstance(level, int) else level

    def digit(k: Column) -> Column:
        out = F.lit(0)
        for a, c in enumerate(cells):
            out = out + F.floor(c / F.pow(F.lit(2.0), level - k)) % 2 * (1 << a)
        return out.cast("int").cast("string")

    return F.when(level == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), level), digit), ""))


def level_of(path: Column) -> Column:
    return F.length(path)


def cell_of(path: Column, axis: int) -> Column:
    """The lattice position of a path on an axis, at its own level."""
    digits = F.transform(F.filter(F.split(path, ""), lambda c: c != ""), lambda c: c.cast("int"))
    return F.aggregate(digits, F.lit(0), lambda acc, d: acc * 2 + F.floor(d / (1 << axis)).cast("int") % 2)


def bounds_of(path: Column) -> list[tuple[Column, Column]]:
    """Lower and upper bound on each axis of the unit box."""
    h = F.pow(F.lit(2.0), -level_of(path))
    return [(cell_of(path, a) * h, (cell_of(path, a) + 1) * h) for a in range(DIMS)]


def prefixes(path: Column, least: int = 0) -> Column:
    """The path and all its parents, the root first."""
    return F.transform(F.sequence(F.lit(least), F.length(path)), lambda k: F.substring(path, F.lit(1), k))


def leaves_of_points(paths: DataFrame, deepest: int, most: int) -> DataFrame:
    """Leaves of the tree that divides every cell with more than ``most`` points; ``paths`` has ``path``."""
    counts = paths.select(F.explode(prefixes(F.col("path"))).alias("z")).groupBy("z").agg(F.count("*").alias("n"))
    divided = counts.filter((F.col("n") > most) & (F.length("z") < deepest)).select("z")
    kids = divided.select(F.explode(F.array(*[F.concat("z", F.lit(str(d))) for d in range(1 << DIMS)])).alias("z"))
    root = paths.sparkSession.createDataFrame([("",)], "z string")
    return kids.union(root).join(divided, "z", "left_anti").select(F.col("z").alias("path"))


def nodes_of(leaves: DataFrame) -> DataFrame:
    """All cells, inner ones too, with level, parent, whether a leaf, and the number of leaves below."""
    x = leaves.select(F.explode(prefixes(F.col("path"))).alias("z"), "path")
    x = x.groupBy("z").agg(F.max((F.col("z") == F.col("path"))).alias("leaf"), F.count("*").alias("n_leaves"))
    return x.select(F.col("z").alias("path"), F.length("z").alias("level"), F.when(F.length("z") > 0, F.expr("substring(z, 1, length(z) - 1)")).alias("parent"), "leaf", "n_leaves")


def numbered(df: DataFrame, path: str = "path", name: str = "id") -> DataFrame:
    """Z-order numbers from 0: rows are stored sorted in ranges, and a number is the rows of earlier ranges and the place inside.

    Ranges are balanced by Spark's sample, whatever prefixes the paths share, and no window runs over rows; equal paths
    get successive numbers in no stated order. What is broadcast has a row for each range.
    """
    ranged = df.repartitionByRange(F.col(path)).sortWithinPartitions(path)
    x = settled(ranged.withColumn("__m", F.monotonically_increasing_id())).withColumn("__p", F.shiftright("__m", 33))
    counts = x.groupBy("__p").agg(F.count("*").alias("__n"))
    upto = W.orderBy("__p").rowsBetween(W.unboundedPreceding, W.currentRow)
    base = counts.select("__p", (F.sum("__n").over(upto) - F.col("__n")).alias("__base"))
    place = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return x.join(F.broadcast(base), "__p").withColumn(name, F.col("__base") + place).drop("__p", "__m", "__base")


def locate(points: DataFrame, leaves: DataFrame) -> DataFrame:
    """``points`` (with ``path`` at the deepest level) and the leaf each lies in, as ``leaf``."""
    x = points.withColumn("__z", F.explode(prefixes(F.col("path"))))
    return x.join(leaves.select(F.col("path").alias("leaf")), F.col("__z") == F.col("leaf")).drop("__z")


def side(region: int, axis: int) -> int:
    return region // 3**axis % 3 - 1


def steps(leaves: DataFrame, periodic: tuple[bool, ...] = (False, False)) -> DataFrame:
    """For each leaf and direction but the middle, the path a step leads to at the leaf's level."""
    n = F.pow(F.lit(2.0), F.length("path")).cast("int")
    out = []
    for region in range(3**DIMS):
        sides = [side(region, a) for a in range(DIMS)]
        if not any(sides):
            continue
        moved, ok = [], F.lit(True)
        for a, s in enumerate(sides):
            c = F.col(f"c{a}") + s
            if periodic[a]:
                c = F.pmod(c, n)
            else:
                ok = ok & (c >= 0) & (c < n)
            moved.append(c)
        out.append(F.struct(F.lit(region).alias("region"), F.when(ok, path_of(moved, F.length("path"))).alias("to")))
    x = leaves.select("path", *[cell_of(F.col("path"), a).alias(f"c{a}") for a in range(DIMS)])
    return x.select("path", F.explode(F.array(*out)).alias("s")).select("path", "s.region", "s.to")


def coarser_neighbors(leaves: DataFrame, periodic=(False, False)) -> DataFrame:
    """(path, region, neighbor): the leaf of the same or a coarser level in each direction."""
    s = steps(leaves, periodic).filter("to is not null").withColumn("z", F.explode(prefixes(F.col("to"))))
    return s.join(leaves.select(F.col("path").alias("neighbor")), F.col("z") == F.col("neighbor")).select("path", "region", "neighbor")


def all_neighbors(leaves: DataFrame, periodic=(False, False)) -> DataFrame:
    """Every touching leaf in each direction: coarser and equal ones, and finer ones by the way back.

    A finer leaf that steps across a corner of its own into the side of a coarse cell touches it in the
    direction in which its path lies, so its direction is taken from the two positions.
    """
    up = coarser_neighbors(leaves, periodic)
    down = up.filter(F.length("neighbor") < F.length("path")).select(F.col("neighbor").alias("path"), (F.lit(3**DIMS - 1) - F.col("region")).alias("region"), F.col("path").alias("neighbor"))
    # the way back is in this direction only if no other axis lies inside the coarse cell
    inside = F.lit(True)
    for a in range(DIMS):
        h = F.pow(F.lit(2.0), F.length("neighbor") - F.length("path"))
        low, c = cell_of(F.col("path"), a) * h, cell_of(F.col("neighbor"), a)
        s = F.floor(F.col("region") / 3**a) % 3
        beyond = ((s == 0) & (c < low)) | ((s == 2) & (c >= low + h)) if not periodic[a] else s != 1
        inside = inside & (((s == 1) & (c >= low) & (c < low + h)) | beyond)
    return up.union(down.filter(inside)).distinct()


def coarse_edges(leaves: DataFrame, periodic=(False, False)) -> DataFrame:
    """(path, neighbor) for touching leaves of which the neighbour is coarser."""
    return coarser_neighbors(leaves, periodic).filter(F.length("neighbor") < F.length("path")).select("path", "neighbor").distinct()


def boundary_faces(leaves: DataFrame) -> DataFrame:
    """The faces of leaves that lie on the edge of the domain."""
    n = F.pow(F.lit(2.0), F.length("path")).cast("int") - 1
    found = F.array(*[F.when(cell_of(F.col("path"), a) == (F.lit(0) if s == 0 else n), F.lit(2 * a + s)) for a in range(DIMS) for s in (0, 1)])
    return leaves.select("path", F.explode(F.filter(found, lambda f: f.isNotNull())).alias("face"))


def refine(leaves: DataFrame, flag: str = "flag") -> DataFrame:
    """Flagged leaves replaced by their halves."""
    kids = F.array(*[F.concat("path", F.lit(str(d))) for d in range(1 << DIMS)])
    return leaves.select(F.explode(F.when(F.col(flag), kids).otherwise(F.array("path"))).alias("path"))


def refine_map(leaves: DataFrame, flag: str = "flag") -> DataFrame:
    """Old number of each leaf, and the number of its first leaf afterwards.

    Old numbers have no gaps, so a window over 65536 of them is bounded, and sums of such groups give where each begins.
    """
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, W.currentRow)
    x = numbered(leaves.select("path", F.when(F.col(flag), 1 << DIMS).otherwise(1).alias("__w")), name="old_id").withColumn("__b", F.shiftright("old_id", 16))
    sums = x.groupBy("__b").agg(F.sum("__w").alias("__s"))
    base = sums.select("__b", (F.sum("__s").over(upto(W.orderBy("__b"))) - F.col("__s")).alias("__base"))
    y = x.withColumn("__c", F.sum("__w").over(upto(W.partitionBy("__b").orderBy("old_id"))) - F.col("__w")).join(base, "__b")
    return y.select("path", "old_id", (F.col("__base") + F.col("__c")).alias("new_id"))


def unbalanced(leaves: DataFrame, edges: DataFrame, flag: str = "flag") -> DataFrame:
    """Flagged leaves that have a coarser neighbour without a flag."""
    flagged = leaves.filter(F.col(flag)).select("path")
    plain = leaves.filter(~F.col(flag)).select(F.col("path").alias("neighbor"))
    return edges.join(flagged, "path").join(plain, "neighbor").select("path").distinct()


def balance_refine(leaves: DataFrame, edges: DataFrame, levels: int, flag: str = "flag") -> DataFrame:
    """Least flags that hold the given ones and those of all coarser neighbours of flagged leaves.

    Each round reaches a strictly coarser level, so ``levels`` rounds are enough; a round starts from what the last
    one reached, as a stored table.
    """
    edges = settled(edges)
    front = settled(leaves.filter(F.col(flag)).select("path"))
    reached = front
    for _ in range(levels):
        front = settled(edges.join(front, "path").select(F.col("neighbor").alias("path")).distinct())
        if front.isEmpty():
            break
        reached = reached.union(front)
    marked = reached.distinct().withColumn("__on", F.lit(True))
    return leaves.join(marked, "path", "left").withColumn(flag, F.coalesce("__on", F.lit(False))).drop("__on")


def parent(path: Column) -> Column:
    return F.when(F.length(path) > 0, F.substring(path, F.lit(1), F.length(path) - 1))


def complete_siblings(leaves: DataFrame, flag: str = "flag") -> DataFrame:
    """Flags kept only where all halves of a parent are leaves and flagged."""
    full = leaves.filter(F.col(flag) & (F.length("path") > 0)).groupBy(parent(F.col("path")).alias("__p")).agg(F.count("*").alias("__n")).filter(F.col("__n") == 1 << DIMS).select("__p")
    x = leaves.join(full, parent(F.col("path")) == F.col("__p"), "left")
    return x.withColumn(flag, F.col("__p").isNotNull()).drop("__p")


def balance_coarsen(leaves: DataFrame, edges: DataFrame, levels: int, flag: str = "flag") -> DataFrame:
    """Largest subset of the flags that keeps neighbours within one level and sibling sets whole.

    A leaf may not coarsen next to a finer leaf that does not. A tree of exactly one division never does. Each round
    spreads by a level, and the last one changes nothing.
    """
    edges = settled(edges)
    x = settled(complete_siblings(leaves, flag))
    for _ in range(levels):
        stay = x.filter(~F.col(flag)).select("path")
        blocked = edges.join(stay, "path").select(F.col("neighbor").alias("path")).distinct().withColumn("__no", F.lit(True))
        y = x.join(blocked, "path", "left").withColumn(flag, F.col(flag) & F.col("__no").isNull()).drop("__no")
        y = settled(complete_siblings(y, flag))
        if x.filter(F.col(flag)).count() == y.filter(F.col(flag)).count():
            return y
        x = y
    return x


def coarsen(leaves: DataFrame, flag: str = "flag") -> DataFrame:
    """Flagged sibling sets replaced by their parents."""
    return leaves.select(F.when(F.col(flag), parent(F.col("path"))).otherwise(F.col("path")).alias("path")).distinct()
