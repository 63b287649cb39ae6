"""Queries on series, histories, parameter ranges and fits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import series as S
from ..functions import weights as K
from ..operators import stencil as ST
from ..operators.stencil import Grid
from .nodes import HN, SQL, hours, points, sql_kernel, sql_window, table  # noqa: F401

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")


def _by_user():
    return W.partitionBy("user_id").orderBy("event_id")


@query("""SELECT event_id, user_id, floor(s / 100e0) > floor((s - v) / 100e0) AS fired FROM (SELECT event_id, user_id, v, sum(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s
FROM (SELECT event_id, user_id, CAST(round(least(abs(value), 100e0)) AS DOUBLE) AS v FROM events))""")
def interval_trigger(spark, sf_dir):
    """Whole increments, so that sums are exact."""
    e = events(spark, sf_dir).withColumn("v", F.round(F.least(F.abs("value"), F.lit(100.0))))
    return e.select("event_id", "user_id", S.triggered(F.col("v"), _by_user(), 100.0).alias("fired"))


@query("""SELECT event_id, user_id, round(sum(value * 0.25e0) OVER w, 4) AS proper_time, round(min(abs(value)) OVER w, 6) AS least_lapse FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def proper_time(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "user_id", F.round(S.running_sum(F.col("value") * 0.25, _by_user()), 4).alias("proper_time"), F.round(S.running_min_abs(F.col("value"), _by_user()), 6).alias("least_lapse"))


@query(f"SELECT event_type, i, round((lag(u, 4) OVER w - 8e0 * lag(u, 3) OVER w + 8e0 * lag(u, 1) OVER w - u) / 12e0, 4) + 0e0 AS rate FROM ({SQL['hours']}) WINDOW w AS (PARTITION BY event_type ORDER BY i)")
def time_derivative_5(spark, sf_dir):
    w = W.partitionBy("event_type").orderBy("i")
    return hours(spark, sf_dir).select("event_type", "i", (F.round(S.backward_rate(F.col("u"), w, 1.0), 4) + 0.0).alias("rate"))


@query("SELECT o_orderkey, o_custkey, first_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS lagged FROM orders")
def lagged_mass(spark, sf_dir):
    """The oldest of each customer's last ten totals."""
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", S.front_of_last(F.col("o_totalprice"), w, 10).alias("lagged"))


@query("SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def history_upsert(spark, sf_dir):
    return S.upsert(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"), ["o_custkey"], F.col("o_orderkey")).drop("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000)")
def uncached_params(spark, sf_dir):
    """Parameters without a long run of one status."""
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' AND o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return S.uncached(table(spark, sf_dir, "customer").select("c_custkey"), done, "c_custkey")


@query("""WITH n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, value > 50 AS s FROM events),
a AS (SELECT user_id, max(k) AS hi, min(k) FILTER (s) AS o, max(k) FILTER (NOT s) AS f FROM n GROUP BY user_id)
SELECT user_id, CAST(CASE WHEN o IS NULL THEN hi WHEN o > 0 THEN o - 1 END AS INTEGER) AS start_place, CAST(CASE WHEN f IS NULL THEN 0 WHEN f < hi THEN f + 1 END AS INTEGER) AS end_place FROM a""")
def bracket(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("k", F.row_number().over(_by_user()) - 1)
    return S.bracket(e, ["user_id"], "k", F.col("value") > 50)


@query("SELECT CAST(i AS BIGINT) AS i, round(power(2e0, (6 - i) * (1e0 / 6) + i * (7e0 / 6)), 9) AS param FROM (SELECT unnest(range(0, 7)) AS i)")
def log_range(spark, sf_dir):
    return N.log_range(spark, 2.0, 128.0, 7).withColumn("param", F.round("param", 9))


@query("SELECT CAST(i AS BIGINT) AS i, round(1e0 + 0.25e0 * i, 9) AS param FROM (SELECT unnest(range(0, 9)) AS i)")
def lin_range(spark, sf_dir):
    return N.lin_range(spark, 1.0, 3.0, 9).withColumn("param", F.round("param", 9))


@query("""SELECT l_returnflag, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM
(SELECT l_returnflag, ln(l_quantity - p + 1e-16) AS x, ln(l_extendedprice) AS y FROM lineitem, (SELECT min(l_quantity) AS p FROM lineitem) WHERE l_quantity - (p - 1e-16) > 1e-10) GROUP BY l_returnflag""")
def power_law_fit(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    least = li.agg((F.min("l_quantity") - 1e-16).alias("p"))
    x = li.join(F.broadcast(least), F.lit(True)).withColumn("d", F.col("l_quantity") - F.col("p")).filter("d > 1e-10")  # one row
    fit = S.power_law(x, ["l_returnflag"], F.col("d"), F.col("l_extendedprice"))
    return fit.select("l_returnflag", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("""SELECT l_orderkey, l_linenumber, round(exp(1.111e0) * power(l_quantity / 50e0, 0.3744e0), 6) AS curve FROM lineitem""")
def power_law_curve(spark, sf_dir):
    # fixed values: offset and exponent of the mass curve
    c = F.exp(F.lit(1.111)) * F.pow(F.col("l_quantity") / 50.0, F.lit(0.3744))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(c, 6).alias("curve"))


@query("""SELECT p.user_id, p.t, (SELECT min(e.event_id) FROM events e WHERE e.user_id = p.user_id AND e.event_id >= p.t) AS event_id
FROM (SELECT user_id, CAST(1000 * k AS BIGINT) AS t FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(0, 5)) AS k)) p""")
def asof_output_index(spark, sf_dir):
    """The first event of each user from each of five numbers on."""
    e = events(spark, sf_dir).select("user_id", "event_id")
    probes = e.select("user_id").distinct().select("user_id", F.explode(F.array(*[F.lit(1000 * k).cast("long") for k in range(5)])).alias("t"))
    return S.first_reaching(probes, e.withColumn("at", F.col("event_id")), ["user_id"], "t", "event_id", "at").withColumnRenamed("at", "event_id")


@query(f"SELECT p_partkey, a * x AS x, b * y AS y FROM ({SQL['points']}), (SELECT unnest([1e0, -1e0]) AS a), (SELECT unnest([1e0, -1e0]) AS b)")
def mirror_quadrant(spark, sf_dir):
    return S.mirrored(points(spark, sf_dir), ["x", "y"])


@query("SELECT user_id, round(log10(mx - ts + 0.605e0), 6) AS x, event_id FROM (SELECT user_id, event_id, event_id / 1000e0 AS ts, max(event_id / 1000e0) OVER (PARTITION BY user_id) AS mx FROM events) WHERE ts < mx")
def self_similarity(spark, sf_dir):
    """Logarithmic distance to the last time of each series, without the last row."""
    t = F.col("event_id") / 1000.0
    last = F.max(t).over(W.partitionBy("user_id"))
    e = events(spark, sf_dir).withColumn("t", t).withColumn("last", last).filter("t < last")
    return e.select("user_id", F.round(F.log10(F.col("last") - F.col("t") + 0.605), 6).alias("x"), "event_id")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey < 5000")
def history_truncate(spark, sf_dir):
    """Rows before a place, as a resumed run keeps them."""
    return S.before(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 5000)


@query("SELECT o_orderkey, round(o_totalprice - (SELECT max(c_acctbal) FROM customer), 4) AS param, o_totalprice / 2 AS mass FROM orders")
def massfill(spark, sf_dir):
    """Masses over the distance from a critical value that another table holds."""
    info = table(spark, sf_dir, "customer").agg(F.max("c_acctbal").alias("pstar"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("param"), (F.col("o_totalprice") / 2).alias("mass"))
    return S.scaling(o, info).withColumn("param", F.round("param", 4))


@query("SELECT event_type, round(sum(v) OVER (PARTITION BY event_type ORDER BY i), 4) AS proper_time, i + 1 AS nodes, (i + 1) // 2 AS dofs FROM (SELECT event_type, i, u / 100e0 AS v FROM (" + SQL["hours"] + "))")
def timevsdofs(spark, sf_dir):
    """Sizes of a mesh over proper time."""
    w = W.partitionBy("event_type").orderBy("i")
    x = hours(spark, sf_dir).withColumn("v", F.col("u") / 100.0)
    return x.select("event_type", F.round(S.running_sum(F.col("v"), w), 4).alias("proper_time"), (F.col("i") + 1).alias("nodes"), F.floor((F.col("i") + 1) / 2).cast("int").alias("dofs"))


@query("""SELECT o_orderkey, round(o_totalprice - (m - 1e-16), 4) AS param, o_totalprice AS mass FROM orders, (SELECT min(o_totalprice) AS m FROM orders WHERE o_orderstatus = 'F') WHERE o_orderstatus = 'F'""")
def masssearch(spark, sf_dir):
    """Collapsed runs only, from the critical value on."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    least = o.agg((F.min("o_totalprice") - 1e-16).alias("p"))
    return o.join(F.broadcast(least), F.lit(True)).select("o_orderkey", F.round(F.col("o_totalprice") - F.col("p"), 4).alias("param"), F.col("o_totalprice").alias("mass"))  # one row


@query(f"SELECT event_type, CAST(min(i) AS INTEGER) AS place, arg_min(u, -u) / 2e0 AS mass FROM (SELECT event_type, i, u FROM ({SQL['hours']}) QUALIFY u = max(u) OVER (PARTITION BY event_type)) GROUP BY event_type")
def find_mass(spark, sf_dir):
    """Where each series is largest first, and half of that value."""
    x = hours(spark, sf_dir).groupBy("event_type").agg(F.min_by(F.struct("i", "u"), F.struct((-F.col("u")).alias("a"), "i")).alias("m"))
    return x.select("event_type", F.col("m.i").alias("place"), (F.col("m.u") / 2).alias("mass"))


@query(None)
def spherical_runs(spark, sf_dir):
    """Whole simulations, one kernel for each batch of parameters.

    The pulse starts at r = 6 with a width of 2, so it has passed the origin by a proper time of 12. As a run ends
    at a lapse of 0.05, it takes at most 12 / (0.05 * 0.03) = 8000 steps.
    """
    from ..operators.spherical import Run, simulated

    out = simulated(N.log_range(spark, 1 / 2048, 1 / 2, 16).repartition(2), Run(steps=8000, max_proper_time=12.0))
    return out.select("param", "status", F.round("mass", 4).alias("mass"), "steps", F.round("least_lapse", 4).alias("least_lapse"))


#: The exponent and the fraction of a double, from its value.
_BITS = """SELECT o_orderkey, CASE WHEN x IS NOT NULL THEN format('{:016x}', CASE WHEN x = 0 THEN CAST(0 AS UBIGINT) ELSE CAST(e + 1023 AS UBIGINT) * CAST(4503599627370496 AS UBIGINT)
  + CAST((abs(x) / power(2e0, e) - 1) * 4503599627370496e0 AS UBIGINT) + CASE WHEN x < 0 THEN CAST(9223372036854775808 AS UBIGINT) ELSE CAST(0 AS UBIGINT) END END) END AS bits
FROM (SELECT o_orderkey, x, CASE WHEN power(2e0, f) > abs(x) THEN f - 1 ELSE f END AS e FROM (SELECT o_orderkey, o_totalprice AS x, floor(log2(nullif(abs(o_totalprice), 0))) AS f FROM orders))"""


@query(_BITS)
def float_keys(spark, sf_dir):
    """Exact keys of doubles: the hex digits of their bits."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return o.select("o_orderkey", N.float_key(F.col("o_totalprice")).alias("bits"))


#: Days as levels of a run, with a node for each hour.
_DAYS = Grid(("event_type", "step"), ("j",), (23,), (1 / 23,))
_LEVELS = f"""SELECT event_type, step, j, u, {sql_kernel(_DAYS, K.derivative(4), 0, 'u', 'w')} AS rhs FROM (SELECT event_type, i // 24 AS step, i % 24 AS j, u FROM ({SQL['hours']})) {sql_window(_DAYS, 0)}"""


@query(f"""SELECT CAST(step AS INTEGER) AS step, round(sqrt(sum(r * r * CASE WHEN j IN (0, 23) THEN 0.5e0 ELSE 1e0 END) / 23e0), 4) AS l2, round(greatest(max(r), 0e0), 4) AS max_norm
FROM (SELECT step, j, (lag(u, 2) OVER t - 8e0 * lag(u) OVER t + 8e0 * lead(u) OVER t - lead(u, 2) OVER t) / 12e0 - rhs AS r FROM ({_LEVELS}) WINDOW t AS (PARTITION BY event_type, j ORDER BY step)) WHERE r IS NOT NULL GROUP BY step""")
def constraint_levels(spark, sf_dir):
    """How far the daily change of hourly sums is from their slope over the hours, from five days each: two norms for each day."""
    x = hours(spark, sf_dir).select("event_type", F.floor(F.col("i") / 24).cast("int").alias("step"), (F.col("i") % 24).cast("int").alias("j"), "u")
    x = x.withColumn("rhs", ST.apply_axis(_DAYS, K.derivative(4), 0, "u"))
    r = S.level_residual(x, ["event_type", "j"], "step", "u", "rhs", 1.0)
    norms = ST.l2_norm(r, _DAYS, "residual", ("step",)).join(ST.max_norm(r, _DAYS, "residual", ("step",)), "step")
    return norms.select("step", F.round("l2", 4).alias("l2"), F.round("max_norm", 4).alias("max_norm"))
