"""Field queries: stencils, ghosts, norms, transfer and time steps on node tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import elements as E
from ..functions import weights as K
from ..operators import approx as AP
from ..operators import boundary as B
from ..operators import stencil as S
from .nodes import EG, EN, HN, SQL, hours, line, num, points, sql_kernel, sql_window, square, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return keep


def _line_kernel(name, kernel):
    query(f"SELECT vec_id, i, round({sql_kernel(EN, kernel, 0, 'u', 'w')}, 6) AS v FROM ({SQL['line']}) {sql_window(EN, 0)}", name)(
        lambda spark, sf_dir: line(spark, sf_dir).select("vec_id", "i", F.round(S.apply_axis(EN, kernel, 0, "u"), 6).alias("v"))
    )


for _o in (2, 4, 6):
    _line_kernel(f"derivative_o{_o}", K.derivative(_o))
    _line_kernel(f"second_derivative_o{_o}", K.derivative(_o, 2))
for _o in (4, 6):
    _line_kernel(f"dissipation_ko{_o}", K.dissipation(_o))
_line_kernel("kernel_value", K.VALUE)


@query(f"SELECT event_type, i, round({sql_kernel(HN, K.dissipation(6), 0, 'u', 'w')}, 8) AS v FROM ({SQL['hours']}) {sql_window(HN, 0)}")
def dissipation_hours(spark, sf_dir):
    return hours(spark, sf_dir).select("event_type", "i", F.round(S.apply_axis(HN, K.dissipation(6), 0, "u"), 8).alias("v"))


@query(f"""WITH a AS (SELECT vec_id, i, j, {sql_kernel(EG, K.derivative(4), 0, 'u', 'w')} AS d FROM ({SQL['square']}) {sql_window(EG, 0)})
SELECT vec_id, i, j, round({sql_kernel(EG, K.derivative(4), 1, 'd', 'w')}, 4) AS v FROM a {sql_window(EG, 1)}""")
def mixed_derivative(spark, sf_dir):
    return S.evaluate(square(spark, sf_dir), EG, lambda e: {"v": F.round(e.mixed_derivative("u", 0, 1), 4)})


_LAPLACE = f"""WITH a AS (SELECT vec_id, i, j, u, {sql_kernel(EG, K.derivative(4, 2), 0, 'u', 'w')} AS d FROM ({SQL['square']}) {sql_window(EG, 0)})
SELECT vec_id, i, j, round(d + {sql_kernel(EG, K.derivative(4, 2), 1, 'u', 'w')}, 4) AS v FROM a {sql_window(EG, 1)}"""


@query(_LAPLACE)
def laplacian_2d(spark, sf_dir):
    return S.evaluate(square(spark, sf_dir), EG, lambda e: {"v": F.round(e.second_derivative("u", 0) + e.second_derivative("u", 1), 4)})


@query(f"""WITH a AS (SELECT vec_id, i, j, u, {sql_kernel(EG, K.derivative(2), 0, 'u', 'w')} AS gx FROM ({SQL['square']}) {sql_window(EG, 0)})
SELECT vec_id, i, j, round(gx, 5) AS gx, round({sql_kernel(EG, K.derivative(2), 1, 'u', 'w')}, 5) AS gy FROM a {sql_window(EG, 1)}""")
def gradient_2d(spark, sf_dir):
    return S.evaluate(square(spark, sf_dir), EG, lambda e: {k: F.round(c, 5) for k, c in zip(("gx", "gy"), e.gradient("u"), strict=True)}, 2)


@query(f"SELECT vec_id, i, round(u + 0.1e0 * ({sql_kernel(EN, K.dissipation(6), 0, 'u', 'w')}), 6) AS u FROM ({SQL['line']}) {sql_window(EN, 0)}")
def mesh_dissipation(spark, sf_dir):
    return S.dissipate(line(spark, sf_dir), EN, "u", 0.1).withColumn("u", F.round("u", 6))


def _sql_mid(order: int, n: int, u: str = "u") -> str:
    k = K.interpolation(order)
    at = lambda o: u if o == 0 else f"lead({u}, {o}) OVER w" if o > 0 else f"lag({u}, {-o}) OVER w"
    cases = []
    for p, row in enumerate(k.left):
        cases.append((p, " + ".join(f"{num(x)} * {at(c - p)}" for c, x in enumerate(row))))
        cases.append((n - 1 - p, " + ".join(f"{num(x)} * {at(p + 1 - c)}" for c, x in enumerate(row))))
    centred = " + ".join(f"{num(x)} * {at(o)}" for o, x in sorted(k.interior.items()))
    return f"CASE {' '.join(f'WHEN i = {a} THEN {e}' for a, e in cases)} ELSE {centred} END"


def _prolong(order):
    mid = f"SELECT vec_id, i, u, {_sql_mid(order, 63)} AS m FROM ({SQL['line']}) {sql_window(EN, 0)}"
    query(f"WITH a AS ({mid}) SELECT vec_id, CAST(2 * i AS INTEGER) AS i, round(u, 6) AS u FROM a UNION ALL SELECT vec_id, CAST(2 * i + 1 AS INTEGER), round(m, 6) FROM a WHERE i < 63", f"prolong_o{order}")(
        lambda spark, sf_dir: S.prolong(line(spark, sf_dir), EN, "u", order).select("vec_id", F.col("i").cast("int").alias("i"), F.round("u", 6).alias("u"))
    )


for _o in (2, 4):
    _prolong(_o)


@query(f"SELECT vec_id, CAST(i // 2 AS INTEGER) AS i, u FROM ({SQL['line']}) WHERE i % 2 = 0")
def inject(spark, sf_dir):
    return S.inject(line(spark, sf_dir), EN)


#: Of 63 cells the last has no even end, so its node is predicted from one side.
_BEYOND = " + ".join(f"{num(x)} * lag(u, {2 * k + 1}) OVER w" for k, x in enumerate(K.beyond(6)))
_DETAIL = f"""WITH f AS (SELECT *, {_BEYOND} AS last FROM ({SQL['line']}) {sql_window(EN, 0)}), c AS (SELECT vec_id, i // 2 AS i, u FROM f WHERE i % 2 = 0),
m AS (SELECT vec_id, i, {_sql_mid(4, 31)} AS m FROM c {sql_window(EN, 0)})
SELECT f.vec_id, f.i, f.u, CASE WHEN f.i = 63 THEN f.last - f.u WHEN f.i % 2 = 1 THEN m.m - f.u ELSE 0e0 END AS detail FROM f LEFT JOIN m ON m.vec_id = f.vec_id AND m.i = f.i // 2 AND f.i % 2 = 1"""


def _detail(spark, sf_dir):
    return S.wavelet_detail(line(spark, sf_dir), EN, "u", 4)


@query(f"SELECT vec_id, i, round(detail, 6) AS detail FROM ({_DETAIL})")
def wavelet_detail(spark, sf_dir):
    return _detail(spark, sf_dir).select("vec_id", "i", F.round("detail", 6).alias("detail"))


@query(f"""SELECT vec_id, CAST(least(i // 6, 10) AS INTEGER) AS cell, round(max(abs(detail)), 6) AS largest, round(max(abs(detail)), 6) >= 0.5 AS refine, round(max(abs(detail)), 6) <= 0.1 AS coarsen
FROM ({_DETAIL}) GROUP BY 1, 2""")
def wavelet_flags(spark, sf_dir):
    d = _detail(spark, sf_dir).withColumn("cell", F.least(F.floor(F.col("i") / 6), F.lit(10)).cast("int"))
    m = d.groupBy("vec_id", "cell").agg(F.round(F.max(F.abs("detail")), 6).alias("largest"))
    return m.withColumn("refine", F.col("largest") >= 0.5).withColumn("coarsen", F.col("largest") <= 0.1)


@query(f"""SELECT vec_id, round(sqrt(sum(d * d * CASE WHEN i IN (0, 63) THEN 0.5e0 ELSE 1e0 END) * {num(1 / 63)}), 6) AS l2 FROM
(SELECT vec_id, i, {sql_kernel(EN, K.derivative(4), 0, 'u', 'w')} AS d FROM ({SQL['line']}) {sql_window(EN, 0)}) GROUP BY vec_id""")
def mesh_l2_norm(spark, sf_dir):
    """The fourth-order derivative of every vector, and its trapezoid norm."""
    d = line(spark, sf_dir).select("vec_id", "i", S.apply_axis(EN, K.derivative(4), 0, "u").alias("d"))
    return S.l2_norm(d, EN, "d", ("vec_id",)).withColumn("l2", F.round("l2", 6))


@query(f"SELECT event_type, round(sqrt(sum(u * u * CASE WHEN i IN (0, 719) THEN 0.5e0 ELSE 1e0 END)), 4) AS l2 FROM ({SQL['hours']}) GROUP BY event_type")
def l2_norm_hours(spark, sf_dir):
    return S.l2_norm(hours(spark, sf_dir), HN, "u", ("event_type",)).withColumn("l2", F.round("l2", 4))


@query(f"SELECT vec_id, greatest(max(u), 0e0) AS max_norm FROM ({SQL['line']}) GROUP BY vec_id")
def max_norm(spark, sf_dir):
    return S.max_norm(line(spark, sf_dir), EN, "u", ("vec_id",))


@query(f"SELECT vec_id, max(abs(u)) AS linf FROM ({SQL['line']}) GROUP BY vec_id")
def linf_norm(spark, sf_dir):
    return S.max_norm(line(spark, sf_dir), EN, "u", ("vec_id",), signed=False)


@query(f"""WITH d AS (SELECT vec_id, i, u, {sql_kernel(EN, K.derivative(4), 0, 'u', 'w')} AS d FROM ({SQL['line']}) {sql_window(EN, 0)})
SELECT vec_id, round(greatest(sqrt(sum(u * u * t) * {num(1 / 63)}), sqrt(sum(d * d * t) * {num(1 / 63)})), 6) AS l2, greatest(max(u), round(max(d), 6), 0e0) AS max_norm
FROM (SELECT *, CASE WHEN i IN (0, 63) THEN 0.5e0 ELSE 1e0 END AS t FROM d) GROUP BY vec_id""")
def system_norms(spark, sf_dir):
    """Largest norm over two channels."""
    x = line(spark, sf_dir).withColumn("d", S.apply_axis(EN, K.derivative(4), 0, "u")).withColumn("t", S.trapezoid_weight(EN))
    l2 = [F.sqrt(F.sum(F.col(c) * F.col(c) * F.col("t")) * F.lit(1 / 63)) for c in ("u", "d")]
    return x.groupBy("vec_id").agg(F.round(F.greatest(*l2), 6).alias("l2"), F.greatest(F.max("u"), F.round(F.max("d"), 6), F.lit(0.0)).alias("max_norm"))


@query(f"""WITH n AS (SELECT vec_id, i, u, unnest(list_distinct([i // 6, CASE WHEN i > 0 THEN (i - 1) // 6 ELSE 0 END])) AS c FROM ({SQL['line']}))
SELECT vec_id, round(sum(o), 6) AS oscillation FROM (SELECT vec_id, c, max(u) - min(u) AS o FROM n WHERE c < 11 GROUP BY 1, 2) GROUP BY vec_id""")
def oscillation(spark, sf_dir):
    return S.oscillation(line(spark, sf_dir), EN, "u", 6, ("vec_id",)).withColumn("oscillation", F.round("oscillation", 6))


@query(f"""WITH n AS (SELECT vec_id, i, u, u * u * u AS v, unnest(list_distinct([i // 6, CASE WHEN i > 0 THEN (i - 1) // 6 ELSE 0 END])) AS c FROM ({SQL['line']}))
SELECT vec_id, round(greatest(sum(o), sum(p)), 6) AS oscillation FROM (SELECT vec_id, c, max(u) - min(u) AS o, max(v) - min(v) AS p FROM n WHERE c < 11 GROUP BY 1, 2) GROUP BY vec_id""")
def oscillation_system(spark, sf_dir):
    """The largest over two channels."""
    x = line(spark, sf_dir).withColumn("v", F.col("u") * F.col("u") * F.col("u"))
    return S.oscillation(x, EN, ["u", "v"], 6, ("vec_id",)).withColumn("oscillation", F.round("oscillation", 6))


@query(f"SELECT vec_id, u FROM ({SQL['line']}) WHERE i = 0")
def bottom_left_value(spark, sf_dir):
    return S.bottom_left(line(spark, sf_dir), EN, "u")


def _ghosts(kind, sign, name):
    base = f"SELECT vec_id, i, CASE WHEN i = 0 THEN 0e0 ELSE u END AS u FROM ({SQL['line']})" if kind == "antisymmetric" else SQL["line"]
    query(f"WITH b AS ({base}) SELECT vec_id, i, u FROM b UNION ALL SELECT vec_id, CAST(-i AS INTEGER), {sign} * u FROM b WHERE i BETWEEN 1 AND 3", name)(
        lambda spark, sf_dir: B.fill_physical(line(spark, sf_dir), EN, "u", {(0, 0): B.Face(kind)}, 3)
    )


_ghosts("symmetric", "1e0", "ghost_symmetric")
_ghosts("antisymmetric", "-1e0", "ghost_antisymmetric")


@query(f"SELECT vec_id, i, CASE WHEN i = 63 THEN 2e0 ELSE u END AS u FROM ({SQL['line']})")
def ghost_dirichlet(spark, sf_dir):
    return B.fill_physical(line(spark, sf_dir), EN, "u", {(0, 1): B.Face("strong_dirichlet", 2.0)}, 3)


@query(f"""WITH b AS (SELECT vec_id, i, j, CASE WHEN j = 0 THEN 0e0 ELSE u END AS u FROM ({SQL['square']})), x AS (SELECT * FROM b UNION ALL SELECT vec_id, CAST(-i AS INTEGER), j, u FROM b WHERE i BETWEEN 1 AND 2)
SELECT * FROM x UNION ALL SELECT vec_id, i, CAST(-j AS INTEGER), -u FROM x WHERE j BETWEEN 1 AND 2""")
def ghost_corners(spark, sf_dir):
    """Even on one axis and odd on the other; corners take the product of the signs."""
    return B.fill_physical(square(spark, sf_dir), EG, "u", {(0, 0): B.Face("symmetric"), (1, 0): B.Face("antisymmetric")}, 2)


_DAYS = f"""SELECT event_type, CAST(d AS BIGINT) AS day, CAST(i - 24 * d AS INTEGER) AS k, u FROM ({SQL['hours']}), (SELECT unnest(range(0, 30)) AS d) WHERE i BETWEEN 24 * d AND 24 * d + 24"""


def _days(spark, sf_dir):
    """Hours in blocks of a day; neighbours share the hour between them, and the last has no such hour at its end."""
    i = F.col("i")
    day = F.floor(i / 24)
    both = F.filter(F.array_distinct(F.array(day, F.floor((i - 1) / 24))), lambda d: (d >= 0) & (d < 30))
    x = hours(spark, sf_dir).withColumn("day", F.explode(both))
    return x.select("event_type", F.col("day").cast("long").alias("day"), (i - 24 * F.col("day")).cast("int").alias("k"), "u")


@query(f"""WITH b AS ({_DAYS}) SELECT event_type, day, k, u FROM b UNION ALL SELECT event_type, day - 1, CAST(k + 24 AS INTEGER), u FROM b WHERE k BETWEEN 1 AND 3 AND day > 0
UNION ALL SELECT event_type, day + 1, CAST(k - 24 AS INTEGER), u FROM b WHERE k BETWEEN 21 AND 23 AND day < 29""")
def ghost_direct(spark, sf_dir):
    return B.fill_direct(_days(spark, sf_dir), "day", "k", 24, "u", 3).filter("day between 0 and 29").select("event_type", "day", "k", "u")


@query(f"""WITH s AS (SELECT event_type, day, k, u, CASE WHEN k = 0 THEN day - 1 ELSE day END AS owner FROM ({_DAYS}))
SELECT event_type, day, k, u, CAST(row_number() OVER (PARTITION BY event_type, 24 * day + k ORDER BY day) AS INTEGER) AS choice FROM s QUALIFY choice = 1""")
def interface_mask(spark, sf_dir):
    """Shared nodes have one source, the block of lowest number."""
    w = F.row_number().over(S.W.partitionBy("event_type", 24 * F.col("day") + F.col("k")).orderBy("day"))
    return _days(spark, sf_dir).withColumn("choice", w).filter("choice = 1")


_ADV = f"SELECT vec_id, i, u, i * {num(1 / 63)} AS x, {sql_kernel(EN, K.derivative(4), 0, 'u', 'w')} AS d FROM ({SQL['line']}) {sql_window(EN, 0)}"


@query(f"""WITH a AS ({_ADV}), b AS (SELECT *, -d AS rate, u - 1e0 + x * d AS adv FROM a)
SELECT vec_id, i, round(CASE WHEN i = 63 THEN -adv / x + (x - {num(1 / 63)}) ** 3 * (lag(rate) OVER w + lag(adv) OVER w / (x - {num(1 / 63)})) / x ** 3 ELSE rate END, 5) AS rate FROM b {sql_window(EN, 0)}""")
def sommerfeld_rhs(spark, sf_dir):
    x = line(spark, sf_dir).withColumn("rate", -S.apply_axis(EN, K.derivative(4), 0, "u"))
    return B.sommerfeld(x, EN, "u", "rate", B.Face("radiative", 1.0)).select("vec_id", "i", F.round("rate", 5).alias("rate"))


@query(f"SELECT vec_id, i, round(CASE WHEN i IN (0, 63) THEN 4e0 * (0.5e0 - u) ELSE -d END, 5) AS rate FROM ({_ADV})")
def weak_dirichlet(spark, sf_dir):
    rate = -S.apply_axis(EN, K.derivative(4), 0, "u")
    return line(spark, sf_dir).select("vec_id", "i", F.round(B.weak_dirichlet(rate, F.col("u"), F.col("i").isin(0, 63), B.Face("weak_dirichlet", 0.5, strength=4.0)), 5).alias("rate"))


@query(f"SELECT p_partkey, round(2e0 * exp(-(((x - 0.5e0) / 0.25e0) * ((x - 0.5e0) / 0.25e0) + ((y - 0.25e0) / 0.5e0) * ((y - 0.25e0) / 0.5e0))), 8) AS u FROM ({SQL['points']})")
def project_gaussian(spark, sf_dir):
    from ..functions.profiles import gaussian

    p = points(spark, sf_dir)
    return p.select("p_partkey", F.round(gaussian([F.col("x"), F.col("y")], 2.0, [0.25, 0.5], [0.5, 0.25]), 8).alias("u"))


@query(f"SELECT p_partkey, round(1.5e0 * tanh((sqrt(x * x + y * y) - 0.7e0) / 0.2e0), 8) AS u FROM ({SQL['points']})")
def project_tanh(spark, sf_dir):
    from ..functions.profiles import tanh

    return points(spark, sf_dir).select("p_partkey", F.round(tanh([F.col("x"), F.col("y")], 1.5, 0.2, 0.7), 8).alias("u"))


@query(f"SELECT vec_id, i, round(u + 0.001e0 * -d, 6) AS u FROM ({_ADV})")
def euler_step(spark, sf_dir):
    return S.euler_step(line(spark, sf_dir), EN, "u", lambda e: -e.derivative("u", 0), 0.001).withColumn("u", F.round("u", 6))


def _sql_rk4(h: float) -> str:
    d = lambda c: f"-({sql_kernel(EN, K.derivative(4), 0, c, 'w')})"
    w = sql_window(EN, 0)
    return f"""WITH a AS (SELECT *, {d('u')} AS k0 FROM ({SQL['line']}) {w}), a1 AS (SELECT *, u + {num(h / 2)} * k0 AS s1 FROM a), b AS (SELECT *, {d('s1')} AS k1 FROM a1 {w}),
b1 AS (SELECT *, u + {num(h / 2)} * k1 AS s2 FROM b), c AS (SELECT *, {d('s2')} AS k2 FROM b1 {w}), c1 AS (SELECT *, u + {num(h)} * k2 AS s3 FROM c), e AS (SELECT *, {d('s3')} AS k3 FROM c1 {w})
SELECT vec_id, i, round(u + {num(h)} * (k0 / 6e0 + k1 / 3e0 + k2 / 3e0 + k3 / 6e0), 5) + 0e0 AS u FROM e"""


@query(_sql_rk4(0.001))
def rk4_step(spark, sf_dir):
    return S.rk4_step(line(spark, sf_dir), EN, "u", lambda e, c: -e.derivative(c, 0), 0.001).withColumn("u", F.round("u", 5) + 0.0)


@query(f"SELECT vec_id, i, round(v + 0.01e0 * ({sql_kernel(EN, K.dissipation(6), 0, 'v', 'w')}), 5) + 0e0 AS u FROM ({_sql_rk4(0.001).replace('round(u + ', '(u + ').replace(', 5) + 0e0 AS u', ') AS v')}) {sql_window(EN, 0)}")
def rk4_filtered(spark, sf_dir):
    """The same step with the filter of order 6 after it."""
    return S.rk4_step(line(spark, sf_dir), EN, "u", lambda e, c: -e.derivative(c, 0), 0.001, amplitude=0.01).withColumn("u", F.round("u", 5) + 0.0)


@query(f"SELECT vec_id, i, round(i * {num(1 / 63)}, 9) AS x, u FROM ({SQL['line']}) WHERE i % 7 = 0")
def stride_export(spark, sf_dir):
    return line(spark, sf_dir).filter("i % 7 = 0").select("vec_id", "i", F.round(EN.position(0), 9).alias("x"), "u")


@query(f"""WITH a AS ({_ADV}) SELECT vec_id, i, round(CASE WHEN x < 1e-15 THEN 2e0 * d ELSE 2e0 * u / x + d END, 5) AS v FROM a""")
def spherical_divergence(spark, sf_dir):
    """``u' + 2 u / r``, with its limit on the axis."""

    def f(e):
        x, d = e.position(0), e.derivative("u", 0)
        return {"v": F.round(F.when(x < 1e-15, 2.0 * d).otherwise(2.0 * F.col("u") / x + d), 5)}

    return S.evaluate(line(spark, sf_dir), EN, f)


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS nodes, CAST(count(*) - 1 AS BIGINT) AS cells FROM (" + SQL["hours"] + ") GROUP BY event_type")
def mesh_counts(spark, sf_dir):
    return hours(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("nodes"), (F.count("*") - 1).alias("cells"))


def _value(s: str, k: str) -> str:
    """The weight of node k of 8 for the nearest quadratic at s, both from the middle on, by discrete orthogonal polynomials."""
    return f"(0.125e0 + {s} * {k} / 42e0 + ({s} * {s} - 5.25e0) * ({k} * {k} - 5.25e0) / 168e0)"


def _slope(s: str, k: str) -> str:
    return f"(3.5e0 * ({k} / 42e0 + 2 * {s} * ({k} * {k} - 5.25e0) / 168e0))"


_WHOLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL)) = 0"


@query(f"""SELECT vec_id, CAST(7 * b + a AS INTEGER) AS target, round(sum({_value('s', 'k')} * {_value('t', 'l')} * u), 6) AS value, round(sum({_slope('s', 'k')} * {_value('t', 'l')} * u), 6) AS ux
FROM (SELECT vec_id, a, b, a - 3e0 AS s, b - 3e0 AS t, i - 3.5e0 AS k, j - 3.5e0 AS l, u FROM ({SQL['square'].replace('FROM embeddings', f'FROM embeddings WHERE {_WHOLE}')}), (SELECT unnest(range(0, 7)) AS a), (SELECT unnest(range(0, 7)) AS b)) GROUP BY vec_id, a, b""")
def least_squares_cells(spark, sf_dir):
    """Value and slope in the middle of each cell, of the quadratic in each axis that is nearest to all vertices."""
    whole = table(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64).filter(~F.exists("embedding", lambda c: c.isNull()))
    x = whole.select("vec_id", F.posexplode("embedding").alias("k", "u")).select("vec_id", (F.col("k") % 8).alias("i"), F.floor(F.col("k") / 8).alias("j"), "u")
    middles = [((a - 3) * 2 / 7, (b - 3) * 2 / 7) for b in range(7) for a in range(7)]
    support, at = E.uniform_points(8, 2), np.array(middles)
    operators = {"value": E.operator_weights(support, 2, at), "ux": E.operator_weights(support, 2, at, (1, 0))}
    out = AP.apply_operator(x, ["vec_id"], ["i", "j"], "u", operators)
    return out.select("vec_id", F.col("target").cast("int").alias("target"), F.round("value", 6).alias("value"), F.round("ux", 6).alias("ux"))
