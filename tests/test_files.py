import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.operators import spherical
from gridlark.operators import mesh
from gridlark.sources import files, vtu


def test_history_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0.3, "Disperse", None), (0.1, "Collapse", 0.25)], files.SEARCH)
    files.write_history(rows, str(tmp_path / "h"))
    good, bad = files.read_history(spark, str(tmp_path / "h"))
    assert [tuple(r) for r in good.orderBy("param").collect()] == [(0.1, "Collapse", 0.25), (0.3, "Disperse", None)]
    (tmp_path / "x.csv").write_text("param,status,mass\n0.5,Collapse,0.1\noops,Collapse,zzz\n")
    good, bad = files.read_history(spark, str(tmp_path / "x.csv"))
    assert good.count() == 1 and len(bad.collect()) == 1


def test_checkpoint_round_trip(spark, tmp_path):
    t = spark.range(4).toDF("k")
    files.save_checkpoint({"cells": t}, {"time": "1.5"}, str(tmp_path / "c"))
    tables, meta = files.load_checkpoint(spark, str(tmp_path / "c"), ["cells"])
    assert tables["cells"].count() == 4 and float(meta["time"]) == 1.5
    with pytest.raises(Exception, match="exist"):
        files.save_checkpoint({"cells": t}, {}, str(tmp_path / "c"))


def test_exports(spark, tmp_path):
    df = spark.range(16).select(F.lit(0).alias("b"), (F.col("id") % 4).cast("int").alias("i"), F.floor(F.col("id") / 4).cast("int").alias("j"), F.col("id").cast("double").alias("u"))
    files.export_csv(df, ["i", "j"], [F.col("i") * 0.5, F.col("j") * 1.0], ["u"], str(tmp_path / "e"), 3)
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).columns == ["Coord0", "Coord1", "u"]
    corners = files.quad_cells(df, ["b"], "i", "j", (3, 3))
    assert corners.count() == 36
    assert [(r.i, r.j) for r in corners.filter("cell_i = 1 and cell_j = 2").orderBy("k").collect()] == [(1, 2), (1, 3), (2, 3), (2, 2)]
    text = files.vtu_text([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0)], [[0, 1]], {"u": [1.0, 2.0]})
    assert 'NumberOfCells="1"' in text and "Field::u" in text


def test_vtu_round_trip(spark, tmp_path):
    leaves = spark.createDataFrame([(p,) for p in ("00", "01", "02", "03", "1", "2", "3")], "path string")
    x, y = (mesh.position(a, 4) for a in range(2))
    nodes = mesh.nodes_of(leaves, 4).withColumn("u", F.exp(x) - y).withColumn("k", F.col("i") * 10 + F.col("j"))
    path = tmp_path / "v"
    path.mkdir()
    (path / "part-lost.vtu").write_text("of a lost attempt")
    vtu.write_vtu(vtu.pieces(nodes, 4, x, y, ["u", "k"]).repartition(3), str(path))
    assert not (path / "part-lost.vtu").exists()
    got = vtu.read_vtu(spark, f"file://{path}").collect()
    assert len(got) == 7 and all(r.quads[:4] == [0, 1, 6, 5] and len(r.quads) == 64 for r in got)
    back = sorted((r.points[3 * n], r.points[3 * n + 1], r.fields["u"][n], r.fields["k"][n]) for r in got for n in range(25))
    assert back == sorted((r.x, r.y, r.u, float(r.k)) for r in nodes.select(x.alias("x"), y.alias("y"), "u", "k").collect())
    index = (path / vtu.INDEX).read_text()
    assert all(p.name in index for p in path.glob("*.vtu")) and 'Name="u"' in index
    with pytest.raises(Exception, match="exists"):
        vtu.write_vtu(vtu.pieces(nodes, 4, x, y, ["u"]), str(path))
    empty = tmp_path / "e"
    vtu.write_vtu(vtu.pieces(nodes.limit(0), 4, x, y, ["u"]), str(empty))
    assert vtu.read_vtu(spark, str(empty)).count() == 0


def test_variables(tmp_path):
    assert files.substituted("some/${arg1}", {"arg1": "10.0"}) == "some/10.0"
    for bad in ("$$=value", "=value", "=", "a=b=c"):
        with pytest.raises(ValueError):
            files.parse_variable(bad)
    assert files.parse_variable("a=1") == ("a", "1")
    files.export_toml({"radius": 40.0, "name": "x${k}", "mesh": {"width": 6, "on": True}}, str(tmp_path / "c.toml"))
    assert files.import_toml(str(tmp_path / "c.toml"), {"k": "7"}) == {"radius": 40.0, "name": "x7", "mesh": {"width": 6, "on": True}}


def test_flat_space_and_strong_fields():
    out = spherical.simulate(np.array([0.0, 1e-4, 1.0]), spherical.Run(cells=48, steps=12))
    assert out["status"].tolist() == ["Disperse", "Disperse", "Collapse"]
    assert abs(out["least_lapse"][0] - 1) < 1e-12 and out["least_lapse"][1] > 0.999
    assert np.isfinite(out["mass"][2])


def test_runs_end_by_proper_time():
    """One amplitude below the critical one and one above it, to the end; one without steps enough; and the batch does not matter."""
    run = spherical.Run(cells=64, steps=2600, max_proper_time=12.0)
    out = spherical.simulate(np.array([0.01, 0.2]), run)
    assert out["status"].tolist() == ["Disperse", "Collapse"]
    assert out["proper_time"][0] >= 12 > out["proper_time"][1] and out["steps"][1] > 5
    assert np.isnan(out["mass"][0]) and out["mass"][1] > 0 and out["least_lapse"][1] < 0.05
    assert spherical.simulate(np.array([0.2]), run)["mass"][0] == out["mass"][1]
    short = spherical.simulate(np.array([0.01]), spherical.Run(cells=64, steps=40, max_proper_time=12.0))
    assert short["status"].tolist() == ["Collapse"] and short["steps"][0] == 40 and np.isfinite(short["mass"][0])


def test_runs_are_independent(spark):
    run = spherical.Run(cells=32, steps=8)
    together = spherical.simulate(np.array([0.001, 0.02]), run)["least_lapse"]
    alone = [spherical.simulate(np.array([x]), run)["least_lapse"][0] for x in (0.001, 0.02)]
    assert np.allclose(together, alone)
    got = spherical.simulated(spark.createDataFrame([(0.001,), (0.02,), (None,)], "param double"), run).orderBy("param").collect()
    assert np.allclose([r.least_lapse for r in got], alone)
