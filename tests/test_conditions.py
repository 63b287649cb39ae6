import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.functions import elements as E
from gridlark.operators import approx as AP
from gridlark.operators import boundary as B
from gridlark.operators import conditions as C
from gridlark.operators import mesh as M
from gridlark.operators import series as S
from gridlark.operators import tree as T
from gridlark.sources import files, vtu


def table(spark, *rows):
    return spark.createDataFrame([(*r, None, None) if len(r) == 4 else r for r in rows], C.RULES)


def test_rules_from_a_table(spark):
    rules = C.conditions(table(spark, ("u", 0, "weak_dirichlet", "0.25"), ("v", 3, "radiative", None)), ["u", "v", "w"])
    assert rules["u"] == {(0, 0): B.Face("weak_dirichlet", 0.25)} and rules["v"] == {(1, 1): B.Face("radiative")} and rules["w"] == {}
    for bad in ((("x", 0, "free", None),), (("u", 4, "free", None),), (("u", 0, "odd", None),), (("u", 0, "free", "nowhere"),), (("u", 0, "free", None), ("u", 0, "symmetric", None))):
        with pytest.raises(ValueError):
            C.conditions(table(spark, *bad), ["u"])
    assert C.conditions(table(spark).limit(0), []) == {}


def test_faces_of_one_leaf(spark):
    """A single leaf has all faces; corners belong to one of them, and nulls stay where no rule sets a value."""
    leaves = spark.createDataFrame([("",)], "path string")
    nodes = M.nodes_of(leaves, 2).withColumn("u", F.lit(None).cast("double")).withColumn("du", F.lit(7.0))
    rules = C.conditions(table(spark, ("u", 0, "weak_dirichlet", "3", None, 2.0), ("u", 1, "strong_dirichlet", "place", None, None), ("u", 3, "antisymmetric", None, None, None)), ["u"], {"place": lambda x, y: x + y})
    got = {(r.i, r.j): (r.u, r.du) for r in C.with_face_conditions(nodes, leaves, 2, rules, {"u": "du"}).collect()}
    assert len(got) == 9 and got[2, 0][0] == 1.0 and got[2, 1] == (1.5, 7.0) and got[2, 2][0] == 0.0 and got[1, 2] == (0.0, 7.0)
    assert got[1, 1] == (None, 7.0) and got[0, 1] == (None, None) and got[0, 2] == (0.0, 6.0)
    kinds = {r.face: r.kind for r in C.block_conditions(leaves, rules).collect()}
    assert kinds == {0: "weak_dirichlet", 1: "strong_dirichlet", 2: "free", 3: "antisymmetric"}
    assert C.with_face_conditions(nodes.limit(0), leaves, 2, rules, {"u": "du"}).count() == 0


def test_shared_faces_are_custom(spark):
    leaves = spark.createDataFrame([("0",), ("1",), ("2",), ("3",)], "path string")
    rules = {"u": {(0, 0): B.Face("symmetric")}, "v": {}}
    got = {(r.path, r.channel, r.face): r.kind for r in C.block_conditions(leaves, rules).collect()}
    assert len(got) == 32 and got["0", "u", 0] == "symmetric" and got["0", "v", 0] == "free" and got["1", "u", 0] == "custom" and got["0", "u", 1] == "custom"


def test_targets_by_place_in_ghost_filling(spark):
    leaves = spark.createDataFrame([("0",), ("1",), ("2",), ("3",)], "path string")
    nodes = M.nodes_of(leaves, 6).withColumn("u", F.lit(0.0))
    x = M.fill_boundary(nodes, leaves, 6, 2, rules={(0, 1): B.Face("strong_dirichlet", lambda x, y: 2 * x + y)})
    on = x.filter("path in ('1', '3') and i = 6 and j between 0 and 6").withColumn("y", M.position(1, 6))
    assert on.count() == 14 and on.filter(F.abs(F.col("u") - 2 - F.col("y")) > 1e-12).count() == 0


@pytest.mark.parametrize("degree, exact", [(2, True), (3, False)])
def test_lower_order(spark, degree, exact):
    """Exact on polynomials of its order, and not on the next."""
    leaves = spark.createDataFrame([("0",), ("1",), ("2",), ("3",)], "path string")
    f = lambda x, y: F.pow(x, F.lit(degree)) * F.pow(y, F.lit(degree)) - y
    nodes = M.nodes_of(leaves, 4).withColumn("u", f(M.position(0, 4), M.position(1, 4)))
    p = spark.range(40).select("id", (F.col("id") * 0.37 % 1).alias("x"), (F.col("id") * 0.61 % 1).alias("y")).withColumn("path", T.path_of([T.lattice(F.col(c), 3) for c in "xy"], 3))
    got = M.values_at(p, nodes, leaves, 4, order=2)
    worst = got.agg(F.max(F.abs(F.col("u") - f(F.col("x"), F.col("y"))))).first()[0]
    assert got.count() == 40 and (worst < 1e-12) == exact
    with pytest.raises(ValueError):
        M.values_at(p, nodes, leaves, 4, order=5)


def test_operators_on_blocks(spark):
    """Rows of a matrix against numpy; a null makes its block null, a missing node is an error."""
    rng = np.random.default_rng(3)
    values, weights = rng.normal(size=(3, 6)), rng.normal(size=(4, 6))
    rows = [(b, k % 3, k // 3, None if (b, k) == (2, 4) else float(v)) for b, vs in enumerate(values) for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "b int, i int, j int, u double")
    got = {(r.b, r.target): r.w for r in AP.apply_operator(df, ["b"], ["i", "j"], "u", {"w": weights}).collect()}
    assert len(got) == 12 and all(got[2, t] is None for t in range(4))
    assert np.allclose([[got[b, t] for t in range(4)] for b in (0, 1)], values[:2] @ weights.T)
    with pytest.raises(Exception, match="missing or repeated"):
        AP.apply_operator(df.filter("i + j > 0"), ["b"], ["i", "j"], "u", {"w": weights}).collect()
    assert AP.apply_operator(df.limit(0), ["b"], ["i", "j"], "u", {"w": weights}).count() == 0
    with pytest.raises(ValueError):
        AP.apply_operator(df, ["b"], ["i", "j"], "u", {"w": weights, "v": E.uniform_points(3)})


def test_levels_against_a_right_hand_side(spark):
    """A quartic in time has an exact derivative; a gap or a repeated level leaves the levels around it out."""
    h = 0.25
    t = lambda s: F.pow(F.col(s) * h, F.lit(4.0))
    x = spark.range(12).select(F.lit("n").alias("node"), F.col("id").alias("step")).withColumn("v", t("step")).withColumn("rhs", 4 * F.pow(F.col("step") * h, F.lit(3.0)) - 0.5)
    got = {r.step: r.residual for r in S.level_residual(x, ["node"], "step", "v", "rhs", h).collect()}
    assert sorted(got) == list(range(2, 10)) and all(abs(v - 0.5) < 1e-9 for v in got.values())
    steps = lambda df: sorted(r.step for r in S.level_residual(df, ["node"], "step", "v", "rhs", h).collect())
    assert steps(x.filter("step <> 5")) == [2, 8, 9] and 5 not in steps(x.union(x.filter("step = 5"))) and steps(x.limit(0)) == []


def test_resumed_history(spark, tmp_path):
    rows = lambda steps, a: spark.createDataFrame([(k, float(k), 0.5 * k, 9, 8, 3, a, 1.0, 0.0, 1.0, 0.1, 0.2, 0.3, "more") for k in steps], files.evolve_schema(1) + ", more string")
    files.write_evolve(rows([3, 1, 0, 2], 1.0), str(tmp_path / "a"), 1)
    old, _ = files.read_history(spark, str(tmp_path / "a"), files.evolve_schema(1))
    files.write_evolve(rows([2, 3, 4], 2.0), str(tmp_path / "b"), 1, old, 2)
    new, _ = files.read_history(spark, str(tmp_path / "b"), files.evolve_schema(1))
    assert new.columns[11:] == ["phi0", "pi0"] and sorted((r.output_index, r.alpha) for r in new.collect()) == [(0, 1.0), (1, 1.0), (2, 2.0), (3, 2.0), (4, 2.0)]


def test_embedded_surface(spark, tmp_path):
    leaves = spark.createDataFrame([("",)], "path string")
    nodes = M.nodes_of(leaves, 2).withColumn("u", F.col("i") + 10.0 * F.col("j"))
    vtu.write_vtu(vtu.pieces(nodes, 2, F.col("i") * 1.0, F.col("j") * 1.0, ["u"], z=F.col("u") / 2), str(tmp_path / "s"))
    piece = vtu.read_vtu(spark, str(tmp_path / "s")).first()
    assert piece.points[2::3] == [v / 2 for v in piece.fields["u"]] and piece.points[-3:] == [2.0, 2.0, 11.0]
