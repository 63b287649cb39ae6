"""Boxes, halves, faces, directions and index spaces as column expressions.

Halves of a cell are whole numbers below 2^N, axis 0 in the low bit. Directions are base-3 numbers below
3^N, axis 0 first; digit 0 is the lower side, 1 the middle, 2 the upper side. Faces are 2 * axis + side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def both(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out & t
    return out


# boxes: lists of columns for each axis


def box_from_corners(aa: list[Column], bb: list[Column]) -> tuple[list[Column], list[Column]]:
    """Origin and size; a negative extent is 0."""
    return aa, [F.greatest(b - a, F.lit(0.0)) for a, b in zip(aa, bb, strict=True)]


def center(origin: list[Column], size: list[Column]) -> list[Column]:
    return [o + s / 2 for o, s in zip(origin, size, strict=True)]


def upper_corner(origin: list[Column], size: list[Column]) -> list[Column]:
    return [o + s for o, s in zip(origin, size, strict=True)]


def contains(origin: list[Column], size: list[Column], x: list[Column]) -> Column:
    """Closed on every axis."""
    return both([(p >= o) & (p <= o + s) for o, s, p in zip(origin, size, x, strict=True)])


def subdivide(origin: list[Column], size: list[Column], split: Column) -> tuple[list[Column], list[Column]]:
    half = [s / 2 for s in size]
    return [o + F.when(bit(split, a), h).otherwise(F.lit(0.0)) for a, (o, h) in enumerate(zip(origin, half, strict=True))], half


def local_to_global(origin: list[Column], size: list[Column], x: list[Column]) -> list[Column]:
    return [o + s * p for o, s, p in zip(origin, size, x, strict=True)]


def global_to_local(origin: list[Column], size: list[Column], x: list[Column]) -> list[Column]:
    return [(p - o) / s for o, s, p in zip(origin, size, x, strict=True)]


# halves


def bit(split: Column, axis: int) -> Column:
    return split.bitwiseAND(F.lit(1 << axis)) != 0


def set_bit(split: Column, axis: int) -> Column:
    return split.bitwiseOR(F.lit(1 << axis))


def clear_bit(split: Column, axis: int) -> Column:
    return split.bitwiseAND(F.lit(~(1 << axis)))


def toggle_bit(split: Column, axis: int) -> Column:
    return split.bitwiseXOR(F.lit(1 << axis))


def pack(bits: list[Column]) -> Column:
    out = F.lit(0)
    for a, b in enumerate(bits):
        out = out + b.cast("int") * (1 << a)
    return out


def unpack(split: Column, dims: int) -> list[Column]:
    return [bit(split, a) for a in range(dims)]


def side(region: Column, axis: int) -> Column:
    """0, 1 or 2: lower, middle or upper."""
    return (F.floor(region / 3**axis) % 3).cast("int")


def is_inner_region(split: Column, region: Column, dims: int) -> Column:
    """Whether a step from this half in this direction stays inside the parent."""
    return both([(side(region, a) == 1) | ((side(region, a) == 2) != bit(split, a)) for a in range(dims)])


def as_outer_region(split: Column, region: Column, dims: int) -> Column:
    """The half with its bits set as the direction's sides say; middle axes keep theirs."""
    out = split
    for a in range(dims):
        out = F.when(side(region, a) == 2, set_bit(out, a)).when(side(region, a) == 0, clear_bit(out, a)).otherwise(out)
    return out


def as_inner_region(split: Column, region: Column, dims: int) -> Column:
    """The half on the opposite sides of the direction; middle axes keep theirs."""
    out = split
    for a in range(dims):
        out = F.when(side(region, a) == 0, set_bit(out, a)).when(side(region, a) == 2, clear_bit(out, a)).otherwise(out)
    return out


def face_is_inner(split: Column, face: Column) -> Column:
    """Whether a face of this half lies inside the parent."""
    up = face % 2 == 1
    return up != (F.shiftright(split, 0).bitwiseAND(F.pow(F.lit(2), F.floor(face / 2)).cast("int")) != 0)


# faces and directions


def face_axis(face: Column) -> Column:
    return F.floor(face / 2).cast("int")


def face_reversed(face: Column) -> Column:
    return F.when(face % 2 == 0, face + 1).otherwise(face - 1)


def reverse_region(region: Column, dims: int) -> Column:
    return F.lit(3**dims - 1) - region


def adjacency(region: Column, dims: int) -> Column:
    """The number of axes on which the direction is not in the middle."""
    out = F.lit(0)
    for a in range(dims):
        out = out + (side(region, a) != 1).cast("int")
    return out


def region_of_face(face: Column, dims: int) -> Column:
    out = F.lit(sum(3**a for a in range(dims)))
    for a in range(dims):
        out = out + F.when(face_axis(face) == a, F.when(face % 2 == 1, 3**a).otherwise(-(3**a))).otherwise(0)
    return out


def split_touches_region(split: Column, region: Column, dims: int) -> Column:
    """Whether a half lies on the side of its parent that the direction points to."""
    return both([(side(region, a) == 1) | ((side(region, a) == 2) == bit(split, a)) for a in range(dims)])


def split_touches_face(split: Column, face: Column, dims: int) -> Column:
    """Whether a half lies on the side of its parent that the face is on."""
    return both([(face_axis(face) != a) | (bit(split, a) == (face % 2 == 1)) for a in range(dims)])


def faces_of_region(region: Column, dims: int) -> Column:
    """The faces that a direction crosses, as an array."""
    crossed = [F.when(side(region, a) != 1, F.lit(2 * a) + F.when(side(region, a) == 2, 1).otherwise(0)) for a in range(dims)]
    return F.filter(F.array(*crossed), lambda f: f.isNotNull())


def owning_face(index: list[Column], size: list[int]) -> Column:
    """The one face that a node on the border of ``0 .. size`` belongs to; lower faces come first, then lower axes; null inside."""
    lower = [F.when(i == 0, 2 * a) for a, i in enumerate(index)]
    upper = [F.when(i == n, 2 * a + 1) for a, (i, n) in enumerate(zip(index, size, strict=True))]
    return F.coalesce(*lower, *upper)


def regions(spark: SparkSession, dims: int) -> DataFrame:
    return spark.range(3**dims).select(F.col("id").cast("int").alias("region"))


def splits(spark: SparkSession, dims: int) -> DataFrame:
    return spark.range(2**dims).select(F.col("id").cast("int").alias("split"))


def faces(spark: SparkSession, dims: int) -> DataFrame:
    return spark.range(2 * dims).select(F.col("id").cast("int").alias("face"))


def regions_of_mask(spark: SparkSession, mask: int, dims: int) -> DataFrame:
    """All directions that step only over faces in the mask, the middle one included."""
    r = F.col("region")
    allowed = [(side(r, a) == 1) | ((side(r, a) == 0) & F.lit(bool(mask >> (2 * a) & 1))) | ((side(r, a) == 2) & F.lit(bool(mask >> (2 * a + 1) & 1))) for a in range(dims)]
    return regions(spark, dims).filter(both(allowed))


# index spaces


def cartesian(linear: Column, size: list[int]) -> list[Column]:
    out, stride = [], 1
    for s in size:
        out.append((F.floor(linear / stride) % s).cast("int"))
        stride *= s
    return out


def linear(index: list[Column], size: list[int]) -> Column:
    out, stride = F.lit(0), 1
    for i, s in zip(index, size, strict=True):
        out = out + i * stride
        stride *= s
    return out


def index_space(spark: SparkSession, size: list[int], names: list[str]) -> DataFrame:
    """Every index, axis 0 fastest; empty if any size is 0."""
    n = 1
    for s in size:
        n *= s
    return spark.range(n).select(F.col("id").alias("linear"), *[c.alias(k) for k, c in zip(names, cartesian(F.col("id"), [max(s, 1) for s in size]), strict=True)])


def plane(df: DataFrame, axis: str, at: int) -> DataFrame:
    return df.filter(F.col(axis) == at)


def border_window(df: DataFrame, names: list[str], size: list[int], region: Column) -> DataFrame:
    """The indices on the border that faces a direction."""
    return df.filter(both([F.when(side(region, a) == 0, F.col(k) == 0).when(side(region, a) == 2, F.col(k) == n - 1).otherwise(F.lit(True)) for a, (k, n) in enumerate(zip(names, size, strict=True))]))
