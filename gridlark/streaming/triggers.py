"""Series of steps that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(steps: DataFrame, time: str, keys: list[str], value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sums for each key and window of time, closed ``late`` after the window's end."""
    x = steps.withWatermark(time, late).groupBy(F.window(time, width), *keys)
    return x.agg(F.sum(value).alias("total"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "total", "n")


def upserted(steps: DataFrame, path: str, keys: list[str], order: str, checkpoint: str):
    """A query that keeps the last row of each key, by ``order``, over all batches.

    Each batch writes a version: the one before with its own rows. A batch that is run again writes the same.
    """

    def last(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        found = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("row"))
        return found.select(*[c if c in keys else F.col(f"row.{c}").alias(c) for c in rows.columns])

    def save(batch: DataFrame, number: int) -> None:
        rows = batch
        if number:
            rows = batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/version={number - 1}"))
        last(rows).write.mode("overwrite").parquet(f"{path}/version={number}")

    return steps.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def latest(spark, path: str) -> DataFrame:
    """The last version that :func:`upserted` has written."""
    rows = spark.read.parquet(path)
    return rows.join(F.broadcast(rows.agg(F.max("version").alias("version"))), "version").drop("version")  # one row
