"""Matrices of weights times the nodes of blocks, as arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(weights: np.ndarray):
    """A matrix as one constant: an array of rows."""
    return F.expr("array(" + ", ".join("array(" + ", ".join(f"{float(w)!r}D" for w in row) + ")" for row in weights) + ")")


def apply_operator(df: DataFrame, block: list[str], axes: list[str], u: str, operators: dict[str, np.ndarray]) -> DataFrame:
    """(block, target, and a column for each operator): rows of weights times the nodes of each block, axis 0 fastest.

    Operators have a row for each target and a column for each node. A block with missing or repeated nodes is an error; a
    null among its values makes its results null. A block travels as one array of as many values as an operator has columns.
    """
    rows, n = next(iter(operators.values())).shape
    if any(w.shape != (rows, n) for w in operators.values()):
        raise ValueError("operators of one call have the same targets and nodes")
    node = F.struct(*[F.col(a) for a in reversed(axes)], F.col(u).cast("double").alias("__u"))
    x = df.groupBy(*block).agg(F.transform(F.array_sort(F.collect_list(node)), lambda c: c["__u"]).alias("__v"))
    whole = F.when(F.size("__v") == n, F.col("__v")).otherwise(F.raise_error(F.lit("a block has missing or repeated nodes")))
    dot = lambda w, v: F.aggregate(F.zip_with(w, v, lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
    x = x.withColumn("__v", whole)
    names = list(operators)
    x = x.select(*block, *[F.transform(matrix(operators[k]), lambda w: dot(w, F.col("__v"))).alias(f"__o{m}") for m, k in enumerate(names)])
    x = x.select(*block, F.posexplode(F.arrays_zip(*[F.col(f"__o{m}") for m in range(len(names))])).alias("target", "__z"))
    return x.select(*block, "target", *[F.col(f"__z.__o{m}").alias(k) for m, k in enumerate(names)])
