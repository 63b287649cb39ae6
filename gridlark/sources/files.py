"""Files of a run: histories, checkpoints, field exports, configurations."""

from __future__ import annotations

import re
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEARCH = "param double, status string, mass double"
FILL = "param double, mass double"
EVOLVE = "output_index long, proper_time double, coord_time double, nodes long, dofs long, levels long, alpha double, grr double, grz double, gzz double, theta double"


def read_history(spark: SparkSession, path: str, schema: str = SEARCH) -> tuple[DataFrame, DataFrame]:
    """The rows of a history CSV, and those that could not be read."""
    rows = spark.read.schema(f"{schema}, _bad string").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    return rows.filter(F.col("_bad").isNull() & F.col("param").isNotNull() if "param" in rows.columns else F.col("_bad").isNull()).drop("_bad"), rows.filter(F.col("_bad").isNotNull())


def write_history(history: DataFrame, path: str) -> None:
    """One row for each parameter, in order."""
    history.orderBy("param").write.mode("overwrite").option("header", True).csv(path)


def read_runs(spark: SparkSession, root: str, schema: str = EVOLVE) -> DataFrame:
    """Every ``<param>/evolve_history.csv`` below a folder whose name is a number, with that number."""
    rows = spark.read.schema(schema).option("header", True).csv(f"{root}/*/evolve_history.csv").withColumn("_f", F.input_file_name())
    return rows.withColumn("param", F.regexp_extract("_f", r"([^/]+)/evolve_history\.csv$", 1).try_cast("double")).filter("param is not null").drop("_f")


def evolve_schema(scalars: int) -> str:
    """The columns of a run's history with its scalar fields."""
    return ", ".join([EVOLVE, *[f"phi{k} double, pi{k} double" for k in range(scalars)]])


def write_evolve(rows: DataFrame, path: str, scalars: int, earlier: DataFrame | None = None, offset: int = 0) -> None:
    """A run's history in a new folder, columns in their fixed order, rows by ``output_index``.

    A resumed run keeps the rows of ``earlier`` below ``offset``. Columns that are missing are an error, others are left out.
    """
    names = [c.split()[0] for c in evolve_schema(scalars).split(", ")]
    whole = rows.select(*names)
    if earlier is not None:
        whole = earlier.select(*names).filter(F.col("output_index") < offset).unionByName(whole)
    whole.orderBy("output_index").write.mode("errorifexists").option("header", True).csv(path)


def save_checkpoint(tables: dict[str, DataFrame], meta: dict[str, str], path: str) -> None:
    """A folder of Parquet tables and a table of texts; an existing one is an error."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(dict(meta),)], "meta map<string,string>").write.mode("errorifexists").parquet(f"{path}/_meta_table")


def load_checkpoint(spark: SparkSession, path: str, names: list[str]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    meta = spark.read.parquet(f"{path}/_meta_table").first()["meta"]
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}, dict(meta)


def export_csv(df: DataFrame, axes: list[str], positions: list, fields: list[str], path: str, stride: int = 1) -> None:
    """Positions and fields of every ``stride``-th node, columns in a fixed order."""
    keep = F.lit(True)
    for a in axes:
        keep = keep & (F.col(a) % stride == 0)
    columns = [p.alias(f"Coord{k}") for k, p in enumerate(positions)]
    df.filter(keep).select(*columns, *sorted(fields)).write.mode("overwrite").option("header", True).csv(path)


def quad_cells(df: DataFrame, block: list[str], i: str, j: str, cells: tuple[int, int]) -> DataFrame:
    """The four corners of every cell, in the order (0,0), (0,1), (1,1), (1,0)."""
    inside = df.filter((F.col(i) < cells[0]) & (F.col(j) < cells[1]))
    corners = F.array(*[F.struct((F.col(i) + a).alias("i"), (F.col(j) + b).alias("j"), F.lit(k).alias("k")) for k, (a, b) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0)))])
    return inside.select(*block, F.col(i).alias("cell_i"), F.col(j).alias("cell_j"), F.explode(corners).alias("c")).select(*block, "cell_i", "cell_j", "c.k", F.col("c.i").alias("i"), F.col("c.j").alias("j"))


def vtu_text(points, cells, fields: dict) -> str:
    """An unstructured grid as XML: points (x, y, z), cells as lists of point numbers, fields by name."""
    kind = {2: 3, 4: 9}
    numbers = lambda xs: " ".join(repr(x) for x in xs)
    array = lambda name, typ, xs, more="": f'<DataArray type="{typ}" Name="{name}"{more} format="ascii">{numbers(xs)}</DataArray>'
    offsets, at = [], 0
    for c in cells:
        at += len(c)
        offsets.append(at)
    data = "".join(array(("Field::" if isinstance(v[0], float) else "IntField::") + k, "Float64" if isinstance(v[0], float) else "Int64", v) for k, v in sorted(fields.items()))
    return (
        '<?xml version="1.0"?><VTKFile type="UnstructuredGrid" version="1.0"><UnstructuredGrid>'
        f'<Piece NumberOfPoints="{len(points)}" NumberOfCells="{len(cells)}"><Points>{array("Points", "Float64", [x for p in points for x in p], " NumberOfComponents=\"3\"")}</Points>'
        f'<Cells>{array("connectivity", "Int64", [k for c in cells for k in c])}{array("offsets", "Int64", offsets)}{array("types", "UInt8", [kind[len(c)] for c in cells])}</Cells>'
        f"<PointData>{data}</PointData></Piece></UnstructuredGrid></VTKFile>"
    )


VARIABLE = re.compile(r"\$\{([^}]*)\}")


def substituted(text: str, variables: dict[str, str]) -> str:
    """``${name}`` replaced; an empty text or an unknown name is an error."""
    if not text:
        raise ValueError("an empty text has nothing to transform")

    def one(m):
        if m[1] not in variables:
            raise KeyError(f"no variable {m[1]}")
        return str(variables[m[1]])

    return VARIABLE.sub(one, text)


def parse_variable(text: str) -> tuple[str, str]:
    """``key=value``; neither side is empty or holds ``$`` or ``=``."""
    m = re.fullmatch(r"([^$=]+)=([^$=]+)", text)
    if not m:
        raise ValueError(f"{text!r} is no key=value")
    return m[1], m[2]


def import_toml(path: str, variables: dict[str, str] | None = None) -> dict:
    def walk(x):
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v) for v in x]
        return substituted(x, variables or {}) if isinstance(x, str) and x else x

    return walk(tomllib.loads(Path(path).read_text()))


def export_toml(values: dict, path: str) -> None:
    """Scalars first, then one table for each nested dict."""

    def value(v):
        return f'"{v}"' if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v)

    lines = [f"{k} = {value(v)}" for k, v in values.items() if not isinstance(v, dict)]
    for k, table in values.items():
        if isinstance(table, dict):
            lines += ["", f"[{k}]", *[f"{a} = {value(b)}" for a, b in table.items()]]
    Path(path).write_text("\n".join(lines) + "\n")


def abs_or_relative(path: str, base: str) -> str:
    return path if Path(path).is_absolute() else str(Path(base) / path)
