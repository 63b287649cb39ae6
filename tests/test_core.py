"""Exact weights, convergence, reference vectors and tensor identities."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.functions import numbers as N
from gridlark.functions import tensor as X
from gridlark.functions import weights as K
from gridlark.operators import series as S
from gridlark.operators import stencil
from gridlark.operators import tree as T


def test_weights():
    assert K.moment_weights(K.vertex_grid(1, 1), Fraction(0), 1) == (Fraction(-1, 2), 0, Fraction(1, 2))
    assert K.moment_weights(K.vertex_grid(0, 4), Fraction(1), 1) == tuple(Fraction(x) for x in ("-1/4", "-5/6", "3/2", "-1/2", "1/12"))
    assert K.moment_weights(K.vertex_grid(0, 7), Fraction(0), 2) == tuple(Fraction(x) for x in ("469/90", "-223/10", "879/20", "-949/18", "41", "-201/10", "1019/180", "-7/10"))
    assert [256 * w for w in K.interpolation(4).interior.values()] == [3, -25, 150, 150, -25, 3]
    assert [256 * w for w in K.interpolation(4).left[1]] == [-7, 105, 210, -70, 21, -3]
    assert K.dissipation(6).interior == {-3: 1, -2: -6, -1: 15, 0: -20, 1: 15, 2: -6, 3: 1}
    for bad in (lambda: K.derivative(3), lambda: K.dissipation(2), lambda: K.interpolation(6)):
        with pytest.raises(ValueError):
            bad()


def wave(spark, n):
    g = stencil.Grid(("b",), ("i", "j"), (n, n), (1 / n, 1 / n))
    df = spark.range((n + 1) ** 2).select(F.lit(0).alias("b"), (F.col("id") % (n + 1)).cast("int").alias("i"), F.floor(F.col("id") / (n + 1)).cast("int").alias("j"))
    return g, stencil.project(df, g, lambda x: F.sin(2 * x[0]) * F.sin(3 * x[1]), "u")


def test_derivative_converges(spark):
    errors = []
    for n in (16, 32, 64):
        g, df = wave(spark, n)
        exact = 6.0 * F.cos(2 * g.position(0)) * F.cos(3 * g.position(1))
        out = stencil.evaluate(df, g, lambda e: {"d": F.abs(e.mixed_derivative("u", 0, 1) - exact)})  # noqa: B023
        errors.append(out.agg(F.max("d")).first()[0])
    assert errors[0] / errors[1] >= 12 and errors[1] / errors[2] >= 14


def test_prolong_converges(spark):
    errors = []
    for n in (16, 32):
        g, df = wave(spark, n)
        fine = stencil.Grid(g.block, g.axes, (2 * n, 2 * n), (0.5 / n, 0.5 / n))
        out = stencil.prolong(df, g, "u", 4)
        errors.append(out.agg(F.max(F.abs(F.col("u") - F.sin(2 * fine.position(0)) * F.sin(3 * fine.position(1))))).first()[0])
    assert errors[0] / errors[1] >= 32


def test_tree_vectors(spark):
    """The unit box divided once, then its first leaf again."""
    leaves = spark.createDataFrame([(p,) for p in ("00", "01", "02", "03", "1", "2", "3")], "path string")
    up = {(r.path, r.region): r.neighbor for r in T.coarser_neighbors(leaves).collect()}
    assert up["03", 5] == "1" and up["03", 7] == "2" and up["03", 8] == "3" and ("00", 3) not in up
    wrapped = {(r.path, r.region): r.neighbor for r in T.coarser_neighbors(leaves, (True, True)).collect()}
    assert wrapped["00", 3] == "1" and wrapped["00", 0] == "3"
    near = {}
    for r in T.all_neighbors(leaves).collect():
        near.setdefault((r.path, r.region), set()).add(r.neighbor)
    assert near["1", 3] == {"01", "03"} and near["2", 1] == {"02", "03"} and near["3", 0] == {"03"}
    points = spark.createDataFrame([(0.0, 0.0), (0.51, 0.67), (0.5, 0.5)], "x double, y double").withColumn("path", T.path_of([T.lattice(F.col("x"), 2), T.lattice(F.col("y"), 2)], 2))
    assert [r.leaf for r in T.locate(points, leaves).orderBy("x", "y").collect()] == ["00", "03", "3"]
    flags = leaves.withColumn("flag", F.length("path") == 2)
    assert {r.path for r in T.coarsen(T.balance_coarsen(flags, T.coarse_edges(flags), 2)).collect()} == {"0", "1", "2", "3"}
    one = leaves.withColumn("flag", F.col("path") == "03")
    balanced = {r.path for r in T.balance_refine(one, T.coarse_edges(one), 2).filter("flag").collect()}
    assert balanced == {"03", "1", "2", "3"}


def test_bracket_vectors():
    t, f = True, False
    assert S.double_headed([t]) == (None, 0) and S.double_headed([f]) == (0, None)
    assert S.double_headed([f, f, t, t]) == (1, 2) and S.double_headed([f, f, t, f, t, t]) == (1, 4)
    lo, hi, seen = S.critical_search(lambda ps: {p: p > math.pi / 10 for p in ps}, 0.0, 1.0, n=7, least=1e-10)
    assert lo <= math.pi / 10 <= hi <= lo + 1e-10
    again = S.critical_search(lambda ps: pytest.fail("a known parameter ran again") if ps else {}, 0.0, 1.0, n=7, least=1e-10, known=seen)
    assert again[:2] == (lo, hi)


def test_float_keys(spark):
    for x in (0.1, -0.0, 1e300, 10.0):
        assert N.decode_float(N.encode_float(x)) == x
    assert spark.range(1).select(N.float_key(F.lit(0.1))).first()[0] == N.encode_float(0.1)
    assert [round(r.param, 8) for r in N.log_range(spark, 2.0, 128.0, 7).collect()] == [2, 4, 8, 16, 32, 64, 128]


def test_triggers_carry(spark):
    out = spark.range(1).select(S.triggered_fold(F.array(*[F.lit(x) for x in (0.4, 0.4, 0.4, 2.5, 0.1, 0.1)]), 1.0).alias("f")).first().f
    assert out == [False, False, True, True, True, False]


def test_packing_of_symmetric_pairs():
    values = list(range(1, 10))
    at = lambda *i: values[X.packed_place(i, "ss")]
    assert at(0, 1, 0, 0) == at(1, 0, 0, 0) == 4 and at(1, 1, 1, 0) == 8


def test_curvature_of_the_sphere():
    """The metric (1, sin^2 theta) has Ricci tensor equal to itself."""
    t = 0.7
    s, c = math.sin(t), math.cos(t)
    zero2 = {i: 0.0 for i in X.indices(3)}
    g = {(0, 0): 1.0, (0, 1): 0.0, (1, 0): 0.0, (1, 1): s * s}
    dg = zero2 | {(1, 1, 0): 2 * s * c}
    ddg = {i: 0.0 for i in X.indices(4)} | {(1, 1, 0, 0): 2 * (c * c - s * s)}
    m = X.Metric(g, dg, ddg)
    r = m.ricci()
    assert all(abs(r[i] - g[i]) < 1e-12 for i in r)
    assert abs(m.cotrace(r) - 2) < 1e-12
    k = m.killing({(0,): 0.0, (1,): 1.0}, {i: 0.0 for i in X.indices(2)})
    assert all(abs(v) < 1e-12 for v in k.values())
    assert np.isclose(X.contract("ij,jk->ik", g, m.inverse())[1, 1], 1)
