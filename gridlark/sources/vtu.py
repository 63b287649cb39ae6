"""Unstructured grids as VTK files: one file for each task, one index for all.

A row is a piece: its points (x, y, z in turn), its quads (four point numbers each) and any number of fields, arrays with one
value for each point. Tasks write pieces as they come and hold one at a time. The index names the files of the attempts
that were committed; files of lost attempts are removed, and without an index a folder counts as unwritten.
"""

from __future__ import annotations

import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructType

INDEX = "index.pvtu"
QUAD = 9  # fixed value: the format's number of a quad
HEAD, TAIL = '<?xml version="1.0"?>\n<VTKFile type="UnstructuredGrid" version="1.0"><UnstructuredGrid>\n', "</UnstructuredGrid></VTKFile>\n"


@dataclass
class Written(WriterCommitMessage):
    name: str
    pieces: int


@dataclass
class File(InputPartition):
    name: str


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def array(name: str, kind: str, values, more: str = "") -> str:
    name = name.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    return f'<DataArray type="{kind}" Name="{name}"{more} format="ascii">{" ".join(map(repr, values))}</DataArray>\n'


def piece_text(points: list[float], quads: list[int], fields: dict[str, tuple[str, list]]) -> str:
    """One piece; fields by name, each with its type. Fields without a value for each point are an error."""
    n = len(points) // 3
    if len(points) % 3 or len(quads) % 4 or any(len(v) != n for _, v in fields.values()):
        raise ValueError("points have three numbers, quads four, and fields a value for each point")
    cells = range(len(quads) // 4)
    return (
        f'<Piece NumberOfPoints="{n}" NumberOfCells="{len(cells)}">\n<Points>{array("Points", "Float64", points, " NumberOfComponents=\"3\"")}</Points>\n'
        f'<Cells>{array("connectivity", "Int64", quads)}{array("offsets", "Int64", [4 * c + 4 for c in cells])}{array("types", "UInt8", [QUAD for _ in cells])}</Cells>\n'
        f"<PointData>{''.join(array(k, t, v) for k, (t, v) in fields.items())}</PointData></Piece>\n"
    )


class VtuWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        names = [f.name for f in schema.fields]
        if not {"points", "quads"} <= set(names) or any(not isinstance(f.dataType, ArrayType) for f in schema.fields):
            raise ValueError("the columns are points, quads and fields, all of them arrays")
        self.path, self.overwrite = path, overwrite
        self.kinds = {f.name: "Float64" if isinstance(f.dataType.elementType, (DoubleType, FloatType)) else "Int64" for f in schema.fields if f.name not in ("points", "quads")}
        store, root = opened(path)
        if not overwrite and store.get_file_info(f"{root}/{INDEX}").type != fs.FileType.NotFound:
            raise ValueError(f"{path} exists")

    def write(self, iterator: Iterator) -> Written:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        name, pieces = f"part-{uuid.uuid4().hex}.vtu", 0
        with store.open_output_stream(f"{root}/{name}") as out:
            out.write(HEAD.encode())
            for row in iterator:
                out.write(piece_text(row["points"], row["quads"], {k: (t, row[k]) for k, t in self.kinds.items()}).encode())
                pieces += 1
            out.write(TAIL.encode())
        return Written(name, pieces)

    def commit(self, messages: list) -> None:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        kept = sorted(m.name for m in messages if m is not None and m.pieces)
        with store.open_output_stream(f"{root}/{INDEX}") as out:
            declared = "".join(f'<PDataArray type="{t}" Name="{k}"/>' for k, t in self.kinds.items())
            files = "".join(f'<Piece Source="{n}"/>\n' for n in kept)
            out.write(f'<?xml version="1.0"?>\n<VTKFile type="PUnstructuredGrid" version="1.0"><PUnstructuredGrid GhostLevel="0"><PPoints><PDataArray type="Float64" NumberOfComponents="3"/></PPoints><PPointData>{declared}</PPointData>\n{files}</PUnstructuredGrid></VTKFile>\n'.encode())
        for found in store.get_file_info(fs.FileSelector(root)):
            if found.base_name.endswith(".vtu") and found.base_name not in kept:
                store.delete_file(found.path)

    def abort(self, messages: list) -> None:
        store, root = opened(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/{m.name}")


class VtuReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[File]:
        store, root = opened(self.path)
        with store.open_input_stream(f"{root}/{INDEX}") as f:
            names = [p.get("Source") for p in ET.fromstring(f.read()).iter("Piece")]
        return [File(n) for n in names] or [File("")]

    def read(self, partition: File) -> Iterator[tuple]:
        if not partition.name:
            return
        store, root = opened(self.path)
        with store.open_input_file(f"{root}/{partition.name}") as f:
            for _, piece in ET.iterparse(f):
                if piece.tag != "Piece":
                    continue
                numbers = lambda a, one: [one(x) for x in (a.text or "").split()]
                fields = {a.get("Name"): numbers(a, float) for a in piece.findall("PointData/DataArray")}
                quads = next(a for a in piece.findall("Cells/DataArray") if a.get("Name") == "connectivity")
                yield numbers(piece.find("Points/DataArray"), float), numbers(quads, int), fields
                piece.clear()


class VtuSource(DataSource):
    """``format("vtu")``: pieces of unstructured grids in a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "vtu"

    def schema(self) -> str:
        return "points array<double>, quads array<int>, fields map<string,array<double>>"

    def reader(self, schema: StructType) -> VtuReader:
        return VtuReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> VtuWriter:
        return VtuWriter(self.options["path"], schema, overwrite)


def pieces(nodes: DataFrame, width: int, x, y, fields: list[str], z=None) -> DataFrame:
    """One row for each leaf: points and fields in the order of (j, i), and the quads between them. Ghosts are left out.

    With ``z`` the mesh lies in three dimensions, as a surface at the places that x, y and z give.
    """
    n = width + 1
    inside = nodes.filter(F.col("i").between(0, width) & F.col("j").between(0, width)).select("path", "i", "j", x.alias("__x"), y.alias("__y"), (F.lit(0.0) if z is None else z).alias("__z"), *fields)
    held = inside.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("j", "i", "__x", "__y", "__z", *fields))).alias("n"))  # a leaf's nodes
    corners = [j * n + i + k for j in range(width) for i in range(width) for k in (0, 1, n + 1, n)]
    points = F.flatten(F.transform("n", lambda v: F.array(v["__x"], v["__y"], v["__z"])))
    return held.select(points.alias("points"), F.expr(f"array({', '.join(map(str, corners))})").alias("quads"), *[F.transform("n", lambda v: v[f]).alias(f) for f in fields])  # noqa: B023


def write_vtu(df: DataFrame, path: str) -> None:
    df.sparkSession.dataSource.register(VtuSource)
    df.write.format("vtu").option("path", path).mode("append").save()


def read_vtu(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(VtuSource)
    return spark.read.format("vtu").option("path", path).load()
