"""Queries on axisymmetric slices. Each case has an exact solution, which its SQL states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import axisymmetric as A
from ..functions import profiles as P
from ..operators import horizon as H
from ..sources import settings
from .nodes import SQL, points, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}
MASS = 0.75


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def places(spark, sf_dir):
    """Parts as points away from the origin; every eighth lies on the axis."""
    return points(spark, sf_dir).select("p_partkey", F.when(F.col("p_partkey") % 8 == 0, 0.0).otherwise(0.5 + F.col("x")).alias("r"), (1.0 + F.col("y")).alias("z"))


_PLACES = f"SELECT p_partkey, CASE WHEN p_partkey % 8 = 0 THEN 0e0 ELSE 0.5e0 + x END AS r, 1e0 + y AS z FROM ({SQL['points']})"
_R = f"SELECT p_partkey, r, z, sqrt(r * r + z * z) AS d FROM ({_PLACES})"


def kernel(df, schema, f):
    """``f(frame)`` for each Arrow batch; ``df``'s first column is the key."""

    def run(frames):
        import pandas as pd

        for x in frames:
            if len(x):
                yield pd.DataFrame({x.columns[0]: x[x.columns[0]], **f(x)})

    return df.mapInPandas(run, schema)


def largest(*tensors):
    import numpy as np

    return np.max([np.abs(v) for t in tensors for v in (t.values() if isinstance(t, dict) else [t])], axis=0)


@query(f"""SELECT p_partkey, 0e0 AS stationary, 0e0 AS constraints, round(-1.5e0 * sqrt({2 * MASS} / (d * d * d)), 6) AS lapse_t, round(-2e0 * 1.5e0 * sqrt({2 * MASS} / (d * d * d)), 6) AS log_lapse_t, round(-{MASS} * r / (d * d * d), 6) + 0e0 AS shift_r_t, round(-{MASS} * z / (d * d * d), 6) AS shift_z_t FROM ({_R})""")
def axisymmetric_rates(spark, sf_dir):
    """A black hole on slices that fall in: it keeps its geometry, and the gauge drives lapse and shift."""

    def f(x):
        import numpy as np

        r, z = x["r"].to_numpy(), x["z"].to_numpy()
        plane, k, y, lapse, shift = A.falling_slices(r, z, MASS)
        theta, zed = A.at_rest(r, z)
        s = A.Slice(plane, k, y, theta, zed, lapse, shift)
        out, log = A.rates(s, "harmonic"), A.rates(s, "log_plus_one_zero_shift")
        still = largest(out["g"], out["seed"], out["k"], out["y"], out["theta"], out["z"], log["shift"])
        named = {"stationary": still, "constraints": largest(out["hamiltonian"], out["momentum"]), "lapse_t": out["lapse"], "log_lapse_t": log["lapse"], "shift_r_t": out["shift"][0,], "shift_z_t": out["shift"][1,]}
        return {n: np.round(v, 6) + 0.0 for n, v in named.items()}

    return kernel(places(spark, sf_dir), "p_partkey long, stationary double, constraints double, lapse_t double, log_lapse_t double, shift_r_t double, shift_z_t double", f)


@query(f"SELECT p_partkey, round(2e0 / d * (1 - sqrt({2 * MASS} / d)), 6) AS expansion FROM ({_R})")
def null_expansion(spark, sf_dir):
    """Of the sphere through each point; zero at twice the mass."""

    def f(x):
        import numpy as np

        r, z = x["r"].to_numpy(), x["z"].to_numpy()
        plane, k, y, _, _ = A.falling_slices(r, z, MASS)
        d, none = np.sqrt(r * r + z * z), np.zeros_like(r)
        return {"expansion": np.round(A.null_expansion(plane, k, y, np.arctan2(z, r), d, none, none), 6)}

    return kernel(places(spark, sf_dir), "p_partkey long, expansion double", f)


_UNIVERSE = """SELECT s_suppkey, 1e0 + s_suppkey % 7 / 10e0 AS a, 0.2e0 + s_suppkey % 5 / 10e0 AS h, 0.05e0 + s_suppkey % 3 / 20e0 AS phi, 0.5e0 AS m FROM supplier"""


@query(f"""SELECT s_suppkey, 0e0 AS hamiltonian, round(-a * a * (h * h - 8 * pi() / 6 * (rho + 3 * p)), 6) AS k_t, round(q, 6) AS phi_t, round(-3 * h * q - m * m * phi, 6) AS pi_t, round(rho, 6) AS energy, round(p, 6) AS pressure
FROM (SELECT *, 0.5e0 * q * q - 0.5e0 * m * m * phi * phi AS p FROM (SELECT *, sqrt(2 * rho - m * m * phi * phi) AS q FROM (SELECT *, 3 * h * h / (8 * pi()) AS rho FROM ({_UNIVERSE}))))""")
def scalar_universe(spark, sf_dir):
    """A massive scalar field alone drives an even universe: its energy, the curvature's rate, and its own."""
    n = F.col("s_suppkey")
    x = table(spark, sf_dir, "supplier").select(n, (1.0 + n % 7 / 10.0).alias("a"), (0.2 + n % 5 / 10.0).alias("h"), (0.05 + n % 3 / 20.0).alias("phi"))

    def f(x):
        import numpy as np

        a, h, phi, m = x["a"].to_numpy(), x["h"].to_numpy(), x["phi"].to_numpy(), 0.5
        q = np.sqrt(6 * h * h / A.KAPPA - m * m * phi * phi)
        none, rest = A.at_rest(a, a)
        plane = A.Plane(1.0 + 0 * a, A.pair(A.Jet(a * a), none, A.Jet(a * a)), none)
        field = A.Matter(A.Jet(phi), A.Jet(q), m)
        s = A.Slice(plane, A.pair(A.Jet(-a * a * h), none, A.Jet(-a * a * h)), none, none, rest, A.Jet(1.0 + 0 * a), rest, [field])
        out, source = A.rates(s), A.scalar_source(plane, field)
        phi_t, pi_t = A.matter_rates(s, field)
        named = {"hamiltonian": out["hamiltonian"], "k_t": out["k"][0, 0], "phi_t": phi_t, "pi_t": pi_t, "energy": source["energy"], "pressure": source["angular"]}
        return {c: np.round(v, 6) + 0.0 for c, v in named.items()}

    return kernel(x, "s_suppkey long, hamiltonian double, k_t double, phi_t double, pi_t double, energy double, pressure double", f)


@query("SELECT n_nationkey, 'converged' AS status, round(2e0 * (0.5e0 + n_nationkey / 50e0), 5) AS radius FROM nation")
def apparent_horizons(spark, sf_dir):
    """A search for each mass; the horizon lies at twice the mass."""
    x = table(spark, sf_dir, "nation").select("n_nationkey", (0.5 + F.col("n_nationkey") / 50.0).alias("param"))

    def state_of(mass):
        def state(r, z):
            plane, k, y, _, _ = A.falling_slices(r, z, mass)
            return plane, k, y

        return state

    return H.searched(x, state_of).join(x, "param").select("n_nationkey", "status", F.round("radius", 5).alias("radius"))


@query(f"""SELECT p_partkey, round(power(1e0 + 0.1e0 * y, 4) * exp(2 * x * 0.3e0 * y), 6) AS grr, round(-0.3e0 * y, 6) + 0e0 AS s, round(power(1 + {MASS} / (2 * greatest(sqrt(x * x + y * y), {MASS} / 10e0)), 4), 6) AS hole,
round(({MASS} - 2 * greatest(sqrt(x * x + y * y), {MASS} / 10e0)) / ({MASS} + 2 * greatest(sqrt(x * x + y * y), {MASS} / 10e0)), 6) AS hole_lapse, round((1 + x) * cos(y * 1.5e0), 6) AS pr, round((1 + x) * sin(y * 1.5e0), 6) AS pz FROM ({SQL['points']})""")
def initial_fields(spark, sf_dir):
    """The metric from a conformal factor and a seed, a black hole's, and a curve's place."""
    x, y = F.col("x"), F.col("y")
    own, hole = P.conformal_metric(x, 1.0 + 0.1 * y, 0.3 * y), P.black_hole_metric(x, y, MASS)
    pr, pz = P.polar(1.0 + x, 1.5 * y)
    named = {"grr": own["grr"], "s": own["s"], "hole": hole["grr"], "hole_lapse": hole["lapse"], "pr": pr, "pz": pz}
    return points(spark, sf_dir).select("p_partkey", *[(F.round(c, 6) + 0.0).alias(n) for n, c in named.items()])


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN t = 0 THEN 2 * q + d ELSE q + p / t + d END + (1 + p) / 4 * (t * (d + q) + 2 * d + 8 * pi() * 0.5e0 * (p * p + q * q + exp(2 * t * d) * power(1 + p, 4) * 0.49e0 * q * q)), 6) AS residual
FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / 97531.7e0 AS p, l_quantity / 49.37e0 AS q, l_discount * 1.0137e0 AS d, l_tax * 9.973e0 AS t FROM lineitem)""")
def conformal_residual(spark, sf_dir):
    """The elliptic equation of initial data, with one massive field; rows without tax lie on the axis."""
    c = F.col
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (c("l_extendedprice") / 97531.7).alias("p"), (c("l_quantity") / 49.37).alias("q"), (c("l_discount") * 1.0137).alias("d"), (c("l_tax") * 9.973).alias("t"))
    p, q, d, t = (c(n) for n in "pqdt")
    out = P.conformal_residual(t, {"v": 1.0 + p, "r": p, "rr": q, "zz": d}, {"v": d, "r": d, "rr": d, "zz": q}, [({"v": q, "r": p, "z": q}, 0.7)])
    return x.select("l_orderkey", "l_linenumber", F.round(out, 6).alias("residual"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN CASE o_orderstatus WHEN 'F' THEN 'Collapse' WHEN 'O' THEN 'Disperse' END END AS status FROM orders""")
def limit_outcomes(spark, sf_dir):
    """What becomes of runs that reach a limit, by their strategy."""
    strategy = F.create_map(*[F.lit(x) for x in ("F", "collapse", "O", "disperse", "P", "ignore")])[F.col("o_orderstatus")]
    return table(spark, sf_dir, "orders").select("o_orderkey", settings.outcome(F.col("o_totalprice") > 200000, strategy).alias("status"))
