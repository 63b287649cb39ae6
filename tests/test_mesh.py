import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.functions import elements as E
from gridlark.operators import blocks as B
from gridlark.operators import boundary as BD
from gridlark.operators import evaluation as V
from gridlark.operators import mesh as M
from gridlark.operators import relax as R
from gridlark.operators import wavelets as WA


def refined(paths, leaf):
    paths = sorted(paths)
    p = paths.pop(leaf)
    return sorted(paths + [p + d for d in "0123"])


def test_greedy_blocks():
    one = refined(list("0123"), 0)
    b = B.greedy_blocks(one)
    assert [x.size for x in b] == [(2, 2), (1, 2), (1, 1)]
    assert [x.leaves for x in b] == [(0, 1, 2, 3), (4, 6), (5,)]
    assert [x.level for x in b] == [2, 1, 1]
    b = B.greedy_blocks(refined(one, 4))
    assert [(x.size, x.leaves) for x in b] == [((4, 2), (0, 1, 4, 5, 2, 3, 6, 7)), ((2, 1), (8, 9))]


def test_block_tables(spark):
    leaves = spark.createDataFrame([(p,) for p in refined(list("0123"), 0)], "path string")
    blocks, cells = B.block_tables(spark, leaves)
    assert [(r.start, r.end) for r in B.node_ranges(blocks, 8, 3).orderBy("block_id").collect()] == [(0, 529), (529, 874), (874, 1099)]
    assert cells.count() == 7
    near = {(r.block_id, r.region): (r.neighbor, r.kind) for r in B.block_neighbors(leaves, cells).collect()}
    assert near[0, 5] == (1, "coarse") and near[0, 7] == (2, "coarse") and near[1, 3] in ((0, "fine"), (2, "direct"))
    with pytest.raises(ValueError):
        B.check_mesh(5, 3)


def test_least_squares_weights():
    assert np.allclose(E.interpolation_weights(4, 3, 0.0), np.array([-1, 9, 9, -1]) / 16)
    x = E.uniform_points(5, 2)
    w = E.operator_weights(x, 3, np.array([[0.3, -0.2]]), (1, 0))
    f = x[:, 0] ** 3 * x[:, 1] + x[:, 0]
    assert np.allclose(w @ f, 3 * 0.09 * -0.2 + 1)
    classes = E.point_classes(6, 1, 2)
    assert [p[0] for p in classes["diagonal_int"]] == [3, 5, 7, 9]
    assert len(E.point_classes(2)["detail"]) == 16


def test_relaxation_solves_poisson():
    n = 24
    x = np.linspace(0, 1, n + 1)
    exact = np.sin(np.pi * x)

    def residual(u):
        r = np.zeros_like(u)
        r[1:-1] = (u[2:] - 2 * u[1:-1] + u[:-2]) * n * n + np.pi**2 * exact[1:-1]
        r[0], r[-1] = -u[0], -u[-1]
        return r

    u, steps = R.relax(np.zeros(n + 1), residual, 1 / n, R.Relaxation(dampening=6.0, cfl=0.5, tolerance=1e-7))
    assert np.abs(u - exact).max() < 2 / n**2 and steps > 10
    with pytest.raises(R.RelaxationError):
        R.relax(np.zeros(n + 1), residual, 1 / n, R.Relaxation(most=3))


def test_blocks_cover_every_leaf(spark):
    """Rectangles of one level, each leaf in one, and no two blocks that could be one along axis 1."""
    paths = refined(refined(refined(list("0123"), 0), 4), 2)
    leaves = spark.createDataFrame([(p,) for p in paths], "path string")
    blocks, cells = B.block_tables(spark, leaves)
    heads = {r.block_id: r for r in blocks.collect()}
    placed = {}
    for r in cells.collect():
        h = heads[r.block_id]
        assert r.path not in placed and len(r.path) == h.level and 0 <= r.p0 < h.n0 and 0 <= r.p1 < h.n1
        assert B.position(r.path) == (h.c0 + r.p0, h.c1 + r.p1)
        placed[r.path] = r.block_id
    assert sorted(placed) == paths and sum(h.n0 * h.n1 for h in heads.values()) == len(paths) and sorted(heads) == list(range(len(heads)))
    assert B.block_tables(spark, leaves.limit(0))[1].count() == 0


def test_ghosts_read_mirrored_ones(spark):
    """An even field of degree 4 on both axes is exact in every ghost, and one of degree 6 only where it is centred."""
    leaves = spark.createDataFrame([(p,) for p in refined(list("0123"), 2)], "path string")
    at = lambda a: M.position(a, 6)
    quartic = lambda x, y: x * x * x * x - 0.5 * x * x * y * y + y
    nodes = M.nodes_of(leaves, 6).withColumn("u", quartic(at(0), at(1)))
    rules = {(0, 0): BD.Face("symmetric")}
    for through in (True, False):
        x = M.fill_boundary(nodes, leaves, 6, 3, rules=rules, through_faces=through)
        worst = x.agg(F.max(F.abs(F.col("u") - quartic(at(0), at(1)))).alias("e"), F.count("*").alias("n"), F.count_distinct("path", "i", "j").alias("d")).first()
        assert worst.e < 1e-12 and worst.n == worst.d
    power = M.nodes_of(leaves, 6).withColumn("u", F.pow(at(0), 6))
    two = [M.fill_boundary(power, leaves, 6, 3, rules=rules, through_faces=t).filter("path = '20' and i > 0 and j < 0").agg(F.max(F.abs(F.col("u") - F.pow(at(0), 6)))).first()[0] for t in (True, False)]
    assert 0 < two[0] < two[1]


def test_missing_nodes_are_an_error(spark):
    leaves = spark.createDataFrame([(p,) for p in refined(list("0123"), 0)], "path string")
    nodes = M.nodes_of(leaves, 6).withColumn("u", F.lit(1.0)).filter("not (path = '1' and i = 2 and j = 2)")
    with pytest.raises(Exception, match="missing or repeated"):
        M.fill_boundary(nodes, leaves, 6, 2).collect()


def test_each_ghost_has_one_source(spark):
    leaves = spark.createDataFrame([(p,) for p in refined(list("0123"), 0)], "path string")
    filled = M.fill_boundary(M.nodes_of(leaves, 6).withColumn("u", F.lit(1.0)), leaves, 6, 3)
    inside = "i between 0 and 6 and j between 0 and 6"
    ghosts = filled.filter(f"not ({inside})").select("path", "i", "j")
    sources = M.interface_sources(leaves, 6, 3)
    assert sources.groupBy("path", "i", "j").count().filter("count > 1").isEmpty()
    assert ghosts.join(sources, ["path", "i", "j"], "left_anti").isEmpty()
    assert sources.filter(f"not ({inside})").count() == ghosts.count()


def test_rules_of_a_mesh(spark):
    leaves = spark.createDataFrame([(p,) for p in refined(list("0123"), 0)], "path string")
    nodes = M.nodes_of(leaves, 6).withColumn("u", F.lit(1.0))
    with pytest.raises(ValueError):
        M.fill_boundary(nodes, leaves, 6, 2, rules={(0, 0): BD.Face("odd")})
    assert V.one_sided_faces({(0, 0): BD.Face("symmetric"), (1, 1): BD.Face("radiative")}) == [(0, 1), (1, 0), (1, 1)]
    with pytest.raises(ValueError):
        WA.flag_wavelets(nodes, leaves, 6, 3, {"u": {}}, order=6, lower=0.0, upper=1.0)


def test_diagonal_weights_keep_polynomials():
    for cells, order, buffer in ((6, 1, 0), (6, 3, 0), (10, 2, 2), (10, 4, 2), (10, 5, 2)):
        rows = WA.diagonal_weights(cells, order, buffer)
        assert [k for k, _ in rows] == [k for k in range(1, cells, 2) if buffer <= k <= cells - buffer]
        for k, row in rows:
            assert not any(row[1::2])
            for degree in range(order + 1):
                assert np.isclose(sum(w * (p / cells) ** degree for p, w in enumerate(row)), (k / cells) ** degree)


def test_wavelet_detail_falls_by_32():
    """The detail of a smooth function around one point at half the spacing, with order 4."""
    errors = []
    for h in (0.1, 0.05, 0.025, 0.0125):
        rows = WA.diagonal_weights(10, 4, 2)
        errors.append(max(abs(sum(w * np.sin(1 + h * (p - 5)) for p, w in enumerate(row)) - np.sin(1 + h * (k - 5))) for k, row in rows))
    assert all(a / b >= 32 for a, b in zip(errors, errors[1:], strict=False))
