"""Uniform blocks of leaves: merging, offsets of nodes, and block neighbours.

Merging finds runs of leaves along axis 1, then joins equal runs along axis 0. A window holds one column of cells of one
level, or the runs of one place and length, so at most as many rows as the mesh has cells along an axis.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tree as T


@dataclass(frozen=True)
class Block:
    level: int
    corner: tuple[int, ...]  # lattice position of the first cell, at the block's level
    size: tuple[int, ...]  # cells on each axis
    leaves: tuple[int, ...]  # in Z-order numbers, axis 0 fastest


def position(path: str, dims: int = T.DIMS) -> tuple[int, ...]:
    out = [0] * dims
    for c in path:
        for a in range(dims):
            out[a] = 2 * out[a] + (int(c) >> a & 1)
    return tuple(out)


def greedy_blocks(paths: list[str], dims: int = T.DIMS) -> list[Block]:
    """Leaves in Z-order merged into boxes: each free leaf grows on axis 0, then on axis 1, and so on.

    Growth stops at the domain's edge, at a change of level and at a leaf that is taken.
    """
    order = sorted(paths)
    free = {(len(p), position(p, dims)): i for i, p in enumerate(order)}
    out = []
    for p in order:
        level, corner = len(p), position(p, dims)
        if (level, corner) not in free:
            continue
        cells, size = [corner], [1] * dims
        for a in range(dims):
            edge = cells
            while True:
                edge = [tuple(c + (k == a) for k, c in enumerate(x)) for x in edge]
                if not all((level, x) in free for x in edge):
                    break
                cells = cells + edge
                size[a] += 1
        cells.sort(key=lambda x: x[::-1])
        out.append(Block(level, corner, tuple(size), tuple(free.pop((level, x)) for x in cells)))
    return out


def block_tables(spark: SparkSession, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``blocks`` (block_id, level, corner and size of each axis) and ``cell_block`` (path, block_id, place of each axis).

    Each leaf is in one block; blocks are rectangles of leaves of one level, numbered in Z-order of their corners. Leaves of
    a column that touch form a run; runs side by side that begin and end alike form a block.
    """
    x = leaves.select("path", F.length("path").alias("level"), *[T.cell_of(F.col("path"), a).alias(f"x{a}") for a in range(2)])
    x = x.withColumn("__run", F.col("x1") - F.row_number().over(W.partitionBy("level", "x0").orderBy("x1")))
    runs = x.groupBy("level", "x0", "__run").agg(F.min("x1").alias("c1"), F.count("*").cast("int").alias("n1"))
    runs = runs.withColumn("__stack", F.col("x0") - F.row_number().over(W.partitionBy("level", "c1", "n1").orderBy("x0")))
    heads = runs.groupBy("level", "c1", "n1", "__stack").agg(F.min("x0").alias("c0"), F.count("*").cast("int").alias("n0"))
    corner = T.path_of([F.col("c0"), F.col("c1")], F.col("level"))
    heads = T.numbered(heads.withColumn("__corner", corner), "__corner", "block_id").withColumn("block_id", F.col("block_id").cast("int")).drop("__corner")
    own = runs.join(heads, ["level", "c1", "n1", "__stack"]).select("level", "x0", "__run", "block_id", "c0", "c1")
    cells = x.join(own, ["level", "x0", "__run"]).select("path", "block_id", *[(F.col(f"x{a}") - F.col(f"c{a}")).alias(f"p{a}") for a in range(2)])
    return heads.select("block_id", "level", "c0", "c1", "n0", "n1"), cells


def check_mesh(width: int, ghost: int) -> None:
    if width % 2 or ghost < width // 2:
        raise ValueError("the width must be even, and ghosts at least half of it")


def node_ranges(blocks: DataFrame, width: int, ghost: int, dims: int = T.DIMS) -> DataFrame:
    """First and end of each block's node numbers, ghosts included."""
    n = F.lit(1)
    for a in range(dims):
        n = n * (F.col(f"n{a}") * width + 1 + 2 * ghost)
    x = blocks.withColumn("nodes", n.cast("long")).withColumn("__b", F.shiftright("block_id", 16))  # numbers are gapless, so a window has 65536 rows
    sums = x.groupBy("__b").agg(F.sum("nodes").alias("__s"))
    rows = lambda w: w.rowsBetween(W.unboundedPreceding, W.currentRow)
    base = sums.select("__b", (F.sum("__s").over(rows(W.orderBy("__b"))) - F.col("__s")).alias("__base"))
    x = x.withColumn("__own", F.sum("nodes").over(rows(W.partitionBy("__b").orderBy("block_id")))).join(base, "__b").withColumn("end", F.col("__base") + F.col("__own"))
    return x.select("block_id", (F.col("end") - F.col("nodes")).alias("start"), "end")


def block_neighbors(leaves: DataFrame, cell_block: DataFrame) -> DataFrame:
    """(block_id, region, neighbor, kind): adjacent blocks in each direction; finer, equal or coarser."""
    own = cell_block.select("path", "block_id")
    other = cell_block.select(F.col("path").alias("neighbor"), F.col("block_id").alias("other"))
    d = F.length("neighbor") - F.length("path")
    x = T.all_neighbors(leaves).withColumn("kind", F.when(d == 0, "direct").when(d == 1, "fine").when(d == -1, "coarse").otherwise(F.raise_error(F.lit("levels are not balanced"))))
    return x.join(own, "path").join(other, "neighbor").filter("block_id <> other").select("block_id", "region", F.col("other").alias("neighbor"), "kind").distinct()
