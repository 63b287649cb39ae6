"""Node sets made from the provided tables, in DataFrame form and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stencil import Grid

#: Components of an embedding as vertices of a 1-D grid on [0, 1].
EN = Grid(("vec_id",), ("i",), (63,), (1 / 63,))
#: The same as 8 x 8 vertices.
EG = Grid(("vec_id",), ("i", "j"), (7, 7), (1 / 7, 1 / 7))
#: Hourly sums of events, one block for each type.
HN = Grid(("event_type",), ("i",), (719,), (1.0,))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line(spark, sf_dir: str, name: str = "u") -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return e.select("vec_id", "i", F.col("v").cast("double").alias(name))


def square(spark, sf_dir: str, name: str = "u") -> DataFrame:
    x = line(spark, sf_dir, name)
    return x.select("vec_id", (F.col("i") % 8).cast("int").alias("i"), F.floor(F.col("i") / 8).cast("int").alias("j"), name)


def hours(spark, sf_dir: str) -> DataFrame:
    """Every (type, hour) from 2024-01-01 on, 720 hours, 0 where there are no events."""
    e = table(spark, sf_dir, "events")
    i = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / 3600e6).cast("int")
    sums = e.select("event_type", i.alias("i"), "value").filter(F.col("i").between(0, 719)).groupBy("event_type", "i").agg(F.sum("value").alias("v"))
    kinds = e.select("event_type").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(719))))
    return kinds.join(sums, ["event_type", "i"], "left").select("event_type", "i", F.coalesce("v", F.lit(0.0)).alias("u"))


def points(spark, sf_dir: str) -> DataFrame:
    """Parts as points of the unit square."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", (F.col("p_size") / F.lit(51.0)).alias("x"), ((F.col("p_retailprice") - F.lit(900.0)) / F.lit(100.0)).alias("y"))


SQL = {
    "line": "SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) AS u FROM embeddings",
    "square": "SELECT vec_id, CAST((generate_subscripts(embedding, 1) - 1) % 8 AS INTEGER) AS i, CAST((generate_subscripts(embedding, 1) - 1) // 8 AS INTEGER) AS j, CAST(unnest(embedding) AS DOUBLE) AS u FROM embeddings",
    "hours": """SELECT k.event_type, CAST(r.i AS INTEGER) AS i, coalesce(s.v, 0e0) AS u FROM (SELECT DISTINCT event_type FROM events) k CROSS JOIN (SELECT unnest(range(0, 720)) AS i) r
      LEFT JOIN (SELECT event_type, CAST(floor((epoch_us(ts) - 1704067200000000) / 3600e6) AS INTEGER) AS i, sum(value) AS v FROM events GROUP BY 1, 2) s ON s.event_type = k.event_type AND s.i = r.i""",
    "points": "SELECT p_partkey, p_size / 51e0 AS x, (p_retailprice - 900e0) / 100e0 AS y FROM part",
}


def num(x: float) -> str:
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def sql_kernel(grid: Grid, kernel, axis: int, u: str, window: str) -> str:
    """The kernel along an axis as a SQL expression over a named window."""

    def at(k: int) -> str:
        return u if k == 0 else f"lead({u}, {k}) OVER {window}" if k > 0 else f"lag({u}, {-k}) OVER {window}"

    def weighted(pairs) -> str:
        return " + ".join(f"{num(x)} * {at(k)}" for k, x in pairs if x)

    i, n = grid.axes[axis], grid.cells[axis]
    low, high = grid.edges(axis)
    cases = []
    for p, row in enumerate(kernel.left):
        if low:
            cases.append((p, weighted([(k - p, x) for k, x in enumerate(row)])))
        if high:
            cases.append((n - p, weighted([(p - k, kernel.mirror * x) for k, x in enumerate(row)])))
    centred = weighted(sorted(kernel.interior.items()))
    whole = f"CASE {' '.join(f'WHEN {i} = {a} THEN {e}' for a, e in cases)} ELSE {centred} END" if cases else centred
    return f"({whole}) * {num(kernel.scale(grid.spacing[axis]))}"


def sql_window(grid: Grid, axis: int, name: str = "w") -> str:
    others = [a for k, a in enumerate(grid.axes) if k != axis]
    return f"WINDOW {name} AS (PARTITION BY {', '.join([*grid.block, *others])} ORDER BY {grid.axes[axis]})"
