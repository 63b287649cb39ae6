"""Refinement flags of uneven meshes from wavelet details.

A leaf travels as one array with its buffer of ghosts. Nodes at odd places on every axis are predicted from the even ones,
axis by axis, by least-squares weights over all of them; the detail is what is missing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import elements as E
from . import mesh as M
from . import tree as T
from .boundary import Rules
from .evaluation import one_sided_faces


def diagonal_weights(cells: int, order: int, buffer: int) -> list[tuple[int, list[float]]]:
    """The odd places of ``cells`` (an even number) that are ``buffer`` or more inside, each with a weight for every place; those of odd ones are 0."""
    even = cells // 2 + 1
    out = []
    for k in range(1, cells, 2):
        if buffer <= k <= cells - buffer:
            row = E.interpolation_weights(even, order, 2 * k / cells - 1)
            out.append((k, [float(row[p // 2]) if p % 2 == 0 else 0.0 for p in range(cells + 1)]))
    return out


def largest_detail(values: Column, cells: int, order: int, buffer: int) -> Column:
    """The largest absolute detail of a leaf's nodes, given as one array with axis 0 fastest."""
    n, rows = cells + 1, diagonal_weights(cells, order, buffer)
    number = lambda v: v.cast("double")
    weights = F.array(*[F.array(*[F.lit(x) for x in row]) for _, row in rows])
    places = F.array(*[F.lit(k) for k, _ in rows])
    add = lambda pairs: F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
    along = F.transform(F.sequence(F.lit(0), F.lit(cells)), lambda j: F.transform(weights, lambda w: add(F.zip_with(F.slice(values, j * n + 1, F.lit(n)), w, lambda v, x: number(v) * x))))
    once = F.transform(F.array(along), lambda r: F.transform(weights, lambda w, s: F.transform(places, lambda i, t: F.abs(add(F.zip_with(r, w, lambda row, x: row[t] * x)) - values[places[s] * n + i]))))
    return F.array_max(F.flatten(once[0]))


def flag_wavelets(nodes: DataFrame, leaves: DataFrame, width: int, ghost: int, rules: Mapping[str, Rules], *, order: int, lower: float, upper: float, exchange: int = 4) -> DataFrame:
    """``leaves`` with ``detail``, ``refine`` and ``coarsen``.

    rules: the channels of ``nodes``, each with its faces' rules. A leaf is refined if a detail of some channel is
    ``upper`` or more, and coarsened if all are ``lower`` or less. Leaves look at a buffer of ``2 * (ghost // 2)`` nodes beyond
    them; those on a face without ghosts have none and are judged by half the order. Ghosts are filled in order ``exchange``.
    """
    buffer = 2 * (ghost // 2)
    if order % 2 or order > (width + 2 * buffer) // 2 or width % 2:
        raise ValueError("the order and the width must be even, and the order at most half of a leaf with its buffer")
    out = None
    place = [T.cell_of(F.col("path"), a) for a in range(T.DIMS)]
    last = F.pow(F.lit(2.0), F.length("path")).cast("int") - 1
    for u, own in rules.items():
        bare = F.lit(False)
        for a, s in one_sided_faces(own):
            bare = bare | (place[a] == (last if s else F.lit(0)))
        filled = M.fill_boundary(nodes, leaves, width, buffer, u, exchange, own).join(leaves.select("path", bare.alias("bare")), "path")
        kept = filled.filter(~F.col("bare") | (F.col("i").between(0, width) & F.col("j").between(0, width)))
        held = kept.groupBy("path", "bare").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "i", u))), lambda x: x[u]).alias("v"))  # a leaf's nodes
        detail = F.when(F.col("bare"), largest_detail(F.col("v"), width, order // 2, 0)).otherwise(largest_detail(F.col("v"), width + 2 * buffer, order, buffer))
        one = held.select("path", detail.alias("detail"))
        out = one if out is None else out.unionByName(one)
    most = out.groupBy("path").agg(F.max("detail").alias("detail"))
    return leaves.join(most, "path").withColumn("refine", F.col("detail") >= upper).withColumn("coarsen", F.col("detail") <= lower)
