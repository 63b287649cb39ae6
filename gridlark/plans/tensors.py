"""Tensor algebra on rows: numeric columns of ``lineitem`` as symmetric 2 x 2 tensors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tensor as X
from .nodes import SQL, points, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}
_BASE = """SELECT l_orderkey, l_linenumber, 1e0 + l_quantity / 51.3e0 AS a, l_discount * 1.0137e0 AS b, 1e0 + l_tax * 9.973e0 AS c, l_extendedprice / 97531.7e0 AS p, l_quantity / 49.37e0 AS q FROM lineitem"""


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def rows(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (1.0 + c("l_quantity") / 51.3).alias("a"), (c("l_discount") * 1.0137).alias("b"), (1.0 + c("l_tax") * 9.973).alias("c"),
        (c("l_extendedprice") / 97531.7).alias("p"), (c("l_quantity") / 49.37).alias("q"),
    )


def metric() -> X.Metric:
    """Rows (a, b, c), with derivatives made of (p, q)."""
    c = F.col
    g = {(0, 0): c("a"), (0, 1): c("b"), (1, 0): c("b"), (1, 1): c("c")}
    d = {(0, 0, 0): c("p"), (0, 0, 1): c("q"), (0, 1, 0): c("q"), (0, 1, 1): c("p"), (1, 1, 0): c("p") + c("q"), (1, 1, 1): c("p") - c("q")}
    d |= {(1, 0, k): d[0, 1, k] for k in range(2)}
    return X.Metric(g, d)


def out(df, named):
    return df.select("l_orderkey", "l_linenumber", *[F.round(v, 6).alias(k) for k, v in named.items()])


@query(f"SELECT l_orderkey, l_linenumber, round(a * a + b * b, 6) AS m00, round(a * b + b * c, 6) AS m01, round(b * b + c * c, 6) AS m11, round(a * p + b * q, 6) AS v0, round(a * p * p + 2e0 * b * p * q + c * q * q, 6) AS s FROM ({_BASE})")
def einsum_contract(spark, sf_dir):
    g, v = metric().g, {(0,): F.col("p"), (1,): F.col("q")}
    m, w = X.contract("ik,kj->ij", g, g), X.contract("ij,j->i", g, v)
    return out(rows(spark, sf_dir), {"m00": m[0, 0], "m01": m[0, 1], "m11": m[1, 1], "v0": w[0,], "s": X.contract("ij,i,j->", g, v, v)})


@query(f"SELECT l_orderkey, l_linenumber, round(det, 6) AS det, round(c / det, 6) AS i00, round(-b / det, 6) AS i01, round(a / det, 6) AS i11, round(p * c + a * (p + q) - 2e0 * b * q, 6) AS d0 FROM (SELECT *, a * c - b * b AS det FROM ({_BASE}))")
def metric_det_inv(spark, sf_dir):
    m = metric()
    inv = m.inverse()
    return out(rows(spark, sf_dir), {"det": m.det(), "i00": inv[0, 0], "i01": inv[0, 1], "i11": inv[1, 1], "d0": m.det_derivs()[0,]})


# first kind with d[i,j,k]: G000 = p/2, G001 = q/2, G011 = d011 - d110/2, G100 = d010 - d001/2, G101 = d110/2, G111 = d111/2
_GAMMA = f"SELECT *, a * c - b * b AS det, 0.5e0 * p AS g000, 0.5e0 * q AS g001, p - 0.5e0 * (p + q) AS g011, q - 0.5e0 * q AS g100, 0.5e0 * (p + q) AS g101, 0.5e0 * (p - q) AS g111 FROM ({_BASE})"


@query(f"SELECT l_orderkey, l_linenumber, round((c * g000 - b * g100) / det, 5) + 0e0 AS c000, round((c * g001 - b * g101) / det, 5) + 0e0 AS c001, round((c * g011 - b * g111) / det, 5) + 0e0 AS c011, round((a * g100 - b * g000) / det, 5) + 0e0 AS c100, round((a * g101 - b * g001) / det, 5) + 0e0 AS c101, round((a * g111 - b * g011) / det, 5) + 0e0 AS c111 FROM ({_GAMMA})")
def christoffel(spark, sf_dir):
    g = metric().christoffel()
    named = {"c" + "".join(map(str, i)): g[i] for i in ((0, 0, 0), (0, 0, 1), (0, 1, 1), (1, 0, 0), (1, 0, 1), (1, 1, 1))}
    return rows(spark, sf_dir).select("l_orderkey", "l_linenumber", *[(F.round(v, 5) + 0.0).alias(k) for k, v in named.items()])


@query(f"SELECT l_orderkey, l_linenumber, round((c * p - 2e0 * b * q + a * p) / det, 5) AS trace, round((c * p - b * q) / det, 5) AS r00, round((c * q - b * p) / det, 5) AS r01 FROM (SELECT *, a * c - b * b AS det FROM ({_BASE}))")
def metric_traces(spark, sf_dir):
    """Trace, and first index raised, of the tensor (p, q, p)."""
    t = {(0, 0): F.col("p"), (0, 1): F.col("q"), (1, 0): F.col("q"), (1, 1): F.col("p")}
    m = metric()
    r = m.raise_first(t)
    return rows(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(m.cotrace(t), 5).alias("trace"), F.round(r[0, 0], 5).alias("r00"), F.round(r[0, 1], 5).alias("r01"))


@query(f"""SELECT l_orderkey, l_linenumber, round(p * p + q * q + a * b + b * a, 6) AS scalar, round(p * p + q * q + 2e0 * (a * 1e0 + b * 0.5e0), 6) AS k00, round(p * (p + q) + q * (p - q) + 2e0 * (b * 0.25e0 + c * 2e0), 6) AS k11 FROM ({_BASE})""")
def lie_derivatives(spark, sf_dir):
    """Of a scalar with gradient (p, q), and of the metric, along the vector (p, q) with constant derivatives."""
    x = {(0,): F.col("p"), (1,): F.col("q")}
    dx = {(0, 0): F.lit(1.0), (0, 1): F.lit(0.25), (1, 0): F.lit(0.5), (1, 1): F.lit(2.0)}
    k = metric().killing(x, dx)
    g = metric().g
    scalar = X.scalar_lie(x, x) + g[0, 0] * g[0, 1] + g[0, 1] * g[0, 0]
    return out(rows(spark, sf_dir), {"scalar": scalar, "k00": k[0, 0], "k11": k[1, 1]})


_BENT = f"SELECT p_partkey, 0.6e0 * x * y AS fx, 0.3e0 * x * x + 0.4e0 * y AS fy, 0.6e0 * y AS fxx, 0.6e0 * x AS fxy, 0.4e0 AS fyy, x, y FROM ({SQL['points']})"


@query(f"SELECT p_partkey, round(-(fxx + fyy), 6) AS r00, 0e0 AS r01, round(-(fxx + fyy), 6) AS r11, round(2 * y - fx * (2 * x * y) + fy * (x * x), 6) AS h00, round(2 * x - fy * (2 * x * y) - fx * (x * x), 6) AS h01, 0e0 AS kept FROM ({_BENT})")
def conformal_curvature(spark, sf_dir):
    """The metric ``exp(2 f)`` times the flat one: Ricci tensor, Hessian of ``x^2 y``, and the metric's own gradient, which is zero."""
    x, y = F.col("x"), F.col("y")
    f = 0.3 * x * x * y + 0.2 * y * y
    d, dd = {0: 0.6 * x * y, 1: 0.3 * x * x + 0.4 * y}, {(0, 0): 0.6 * y, (0, 1): 0.6 * x, (1, 0): 0.6 * x, (1, 1): F.lit(0.4)}
    staged = points(spark, sf_dir).select("p_partkey", "x", "y", F.exp(2.0 * f).alias("e"), *[d[k].alias(f"f{k}") for k in d], *[dd[k].alias(f"f{k[0]}{k[1]}") for k in dd])
    c, zero = F.col, F.lit(0.0)
    first = {k: 2.0 * c(f"f{k}") * c("e") for k in range(2)}
    second = {k: (2.0 * c(f"f{k[0]}{k[1]}") + 4.0 * c(f"f{k[0]}") * c(f"f{k[1]}")) * c("e") for k in dd}
    m = X.Metric(
        X.build(2, lambda i, j: c("e") if i == j else zero),
        X.build(3, lambda i, j, k: first[k] if i == j else zero),
        X.build(4, lambda i, j, k, n: second[k, n] if i == j else zero),
    )
    u, uu = {(0,): 2.0 * x * y, (1,): x * x}, {(0, 0): 2.0 * y, (0, 1): 2.0 * x, (1, 0): 2.0 * x, (1, 1): zero}
    r, h, kept = m.ricci(), m.scalar_hessian(u, uu), m.symmetric_gradient(m.g, m.dg)
    named = {"r00": r[0, 0], "r01": r[0, 1], "r11": r[1, 1], "h00": h[0, 0], "h01": h[0, 1], "kept": F.greatest(*[F.abs(v) for v in kept.values()])}
    return staged.select("p_partkey", *[(F.round(v, 6) + 0.0).alias(k) for k, v in named.items()])
