"""Parameter ranges and exact keys of doubles."""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def log_range(spark: SparkSession, a: float, b: float, n: int) -> DataFrame:
    """``n`` values spaced evenly in base-2 logarithm, both ends included: i, param."""
    if n < 2:
        raise ValueError("a logarithmic range has two values at least")
    la, lb = math.log2(a) / (n - 1), math.log2(b) / (n - 1)
    i = F.col("i")
    return spark.range(n).select(F.col("id").alias("i")).select("i", F.pow(F.lit(2.0), (F.lit(n - 1) - i) * F.lit(la) + i * F.lit(lb)).alias("param"))


def lin_range(spark: SparkSession, a: float, b: float, n: int) -> DataFrame:
    """``n`` values from ``a`` on with equal steps, the last one ``b``; a single one is ``a``."""
    step = (b - a) / (n - 1) if n > 1 else 0.0
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(a) + F.lit(step) * F.col("id")).alias("param"))


def encode_float(x: float) -> str:
    """The 16 hex digits of a double's bits."""
    return struct.pack(">d", x).hex()


def decode_float(text: str) -> float:
    if len(text) != 16:
        raise ValueError(f"{text!r} has not 16 hex digits")
    return struct.unpack(">d", bytes.fromhex(text))[0]


def float_key(column: Column) -> Column:
    """:func:`encode_float` for a column, in Arrow batches; null stays null."""
    @F.pandas_udf("string")
    def key(values: pd.Series) -> pd.Series:
        # nulls arrive as not-a-number, which a column of doubles may hold as well; the caller's `when` tells them apart
        text = np.ascontiguousarray(values.to_numpy(float, na_value=np.nan), ">f8").tobytes().hex()
        return pd.Series([text[k : k + 16] for k in range(0, len(text), 16)], index=values.index, dtype=object)

    return F.when(column.isNotNull(), key(column))
