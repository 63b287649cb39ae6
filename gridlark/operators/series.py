"""Series over steps of a run: triggers, accumulators, histories, brackets, as-of lookups, fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import weights as K


def triggered(increment: Column, window, interval: float) -> Column:
    """Whether a step makes the running sum pass a multiple of the interval; needs increments up to it.

    After firing, the interval is subtracted, so what is beyond it carries over.
    """
    upto = F.sum(increment).over(window.rowsBetween(W.unboundedPreceding, W.currentRow))
    return F.floor(upto / F.lit(interval)) > F.floor((upto - increment) / F.lit(interval))


def triggered_fold(increments: Column, interval: float, first: bool = False) -> Column:
    """The same for any increments, as a fold over an array: at most one firing a step, the rest carries."""
    start = F.struct(F.lit(interval if first else 0.0).alias("left"), F.array().cast("array<boolean>").alias("fired"))

    def step(acc: Column, x: Column) -> Column:
        now = acc["left"] + x
        fire = now >= F.lit(interval)
        return F.struct(F.when(fire, now - F.lit(interval)).otherwise(now).alias("left"), F.concat(acc["fired"], F.array(fire)).alias("fired"))

    return F.aggregate(increments, start, step, lambda acc: acc["fired"])


def running_sum(value: Column, window) -> Column:
    return F.sum(value).over(window.rowsBetween(W.unboundedPreceding, W.currentRow))


def running_min_abs(value: Column, window) -> Column:
    return F.min(F.abs(value)).over(window.rowsBetween(W.unboundedPreceding, W.currentRow))


def backward_rate(value: Column, window, h: float) -> Column:
    """Derivative in the middle of the last five values: at two steps back, of fourth order."""
    lag = lambda k: F.lag(value, k).over(window)
    return (lag(4) - 8.0 * lag(3) + 8.0 * lag(1) - value) / F.lit(12.0 * h)


def front_of_last(value: Column, window, n: int) -> Column:
    """The oldest of the last ``n`` values."""
    return F.first(value).over(window.rowsBetween(-(n - 1), 0))


def upsert(history: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    columns = [c for c in history.columns if c not in keys]
    return history.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("__v")).select(*keys, *[F.col(f"__v.{c}").alias(c) for c in columns])


def uncached(params: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Parameters that the history does not have."""
    return params.join(history.select(key).distinct(), key, "left_anti")


def bracket(df: DataFrame, by: list[str], place: str, state: Column) -> DataFrame:
    """For each series: the last place of the leading run without ``state``, and the first of the trailing run with it.

    A leading (trailing) run that is empty gives null.
    """
    x = df.withColumn("__s", state)
    first_on = F.min(F.when(F.col("__s"), F.col(place)))
    last_off = F.max(F.when(~F.col("__s"), F.col(place)))
    a = x.groupBy(*by).agg(F.min(place).alias("__lo"), F.max(place).alias("__hi"), first_on.alias("__on"), last_off.alias("__off"))
    start = F.when(F.col("__on").isNull(), F.col("__hi")).when(F.col("__on") > F.col("__lo"), F.col("__on") - 1)
    end = F.when(F.col("__off").isNull(), F.col("__lo")).when(F.col("__off") < F.col("__hi"), F.col("__off") + 1)
    return a.select(*by, start.alias("start_place"), end.alias("end_place"))


def double_headed(states: list[bool]) -> tuple[int | None, int | None]:
    """The same for one list on the driver."""
    n = len(states)
    lead = next((i for i, s in enumerate(states) if s), n)
    trail = next((i for i in range(n) if not states[n - 1 - i]), n)
    return (lead - 1 if lead else None), (n - trail if trail else None)


def section_points(start: float, end: float, n: int) -> list[float]:
    """The points that divide a bracket, in the floating form that keys histories."""
    out = []
    for i in range(n):
        w = (i + 1) / (n + 1)
        out.append((1 - w) * start + w * end)
    return out


def critical_search(run, start: float, end: float, *, n: int = 8, least: float = 1e-14, most: int = 64, known: dict[float, bool] | None = None) -> tuple[float, float, dict[float, bool]]:
    """k-section search: ``run(list of parameters) -> {parameter: collapsed}`` is one distributed job a round.

    ``start`` does not collapse and ``end`` does. Known parameters are not run again. More than one
    transition is an error.
    """
    history = dict(known or {})
    for _ in range(most):
        if abs(end - start) <= least:
            break
        points = section_points(start, end, n)
        history.update(run([p for p in points if p not in history]))
        states = [history[p] for p in points]
        a, b = double_headed(states)
        if (a if a is not None else -1) + 1 != (b if b is not None else n):
            raise ValueError("more than one transition between the ends of the bracket")
        start, end = (points[a] if a is not None else start), (points[b] if b is not None else end)
    return start, end, history


def first_reaching(probes: DataFrame, series: DataFrame, by: list[str], probe: str, time: str, value: str) -> DataFrame:
    """For each probe, the value at the first time not before it (a forward as-of lookup).

    Union, then one window from the end: no range join.
    """
    a = probes.select(*by, F.col(probe).alias("__t"), F.lit(1).alias("__p"), F.lit(None).cast(series.schema[value].dataType).alias("__v"))
    b = series.select(*by, F.col(time).alias("__t"), F.lit(0).alias("__p"), F.col(value).alias("__v"))
    w = W.partitionBy(*by).orderBy(F.col("__t").desc(), F.col("__p").asc(), F.col("__v").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    x = a.unionByName(b).withColumn("__f", F.last("__v", ignorenulls=True).over(w))
    return x.filter("__p = 1").select(*by, F.col("__t").alias(probe), F.col("__f").alias(value))


def critical_value(df: DataFrame, param: str, below: float = 1e-16) -> Column:
    return F.min(param) - F.lit(below)


def power_law(df: DataFrame, by: list[str], distance: Column, mass: Column) -> DataFrame:
    """Slope and intercept of ``ln mass`` over ``ln distance``."""
    x = df.select(*by, F.log(distance).alias("__x"), F.log(mass).alias("__y"))
    return x.groupBy(*by).agg(F.regr_slope("__y", "__x").alias("slope"), F.regr_intercept("__y", "__x").alias("intercept"))


def mirrored(df: DataFrame, axes: list[str]) -> DataFrame:
    """The four copies (or 2^N) of a quadrant, by the signs of its axes."""
    out = df
    for a in axes:
        out = out.withColumn("__s", F.explode(F.array(F.lit(1.0), F.lit(-1.0)))).withColumn(a, F.col("__s") * F.col(a)).drop("__s")
    return out


def scaling(history: DataFrame, info: DataFrame, param: str = "param", critical: str = "pstar") -> DataFrame:
    """The history with ``param`` as the distance from the critical one, which ``info`` holds in one row."""
    return history.join(F.broadcast(info.select(F.col(critical).alias("__p")).limit(1)), F.lit(True)).withColumn(param, F.col(param) - F.col("__p")).drop("__p")  # one row


def level_residual(df: DataFrame, node: list[str], step: str, value: str, rhs: str, h: float) -> DataFrame:
    """(node, step, residual): the fourth-order time derivative of stored levels, less the right-hand side of the same level.

    Each level needs the two before it and the two after it; where one is missing or stored twice there is no row.
    """
    w = W.partitionBy(*node).orderBy(step)
    near = {k: F.lag(F.struct(F.col(step).alias("s"), F.col(value).cast("double").alias("v")), -k).over(w) for k in (-2, -1, 1, 2)}
    x = df.select(*node, F.col(step), F.col(rhs).cast("double").alias("__rhs"), *[c.alias(f"__l{k + 2}") for k, c in near.items()])
    for k in near:
        x = x.filter(F.col(f"__l{k + 2}.s") == F.col(step) + k)
    kernel = K.derivative(4)
    slope = sum((F.lit(float(kernel.interior[k]) * float(kernel.scale(h))) * F.col(f"__l{k + 2}.v") for k in near), F.lit(0.0))
    return x.select(*node, step, (slope - F.col("__rhs")).alias("residual"))


def before(history: DataFrame, order: str, at) -> DataFrame:
    """The rows that a run resumed at a place keeps."""
    return history.filter(F.col(order) < F.lit(at))
