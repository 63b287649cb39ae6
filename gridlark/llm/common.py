"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where it names none, a folder of this machine is set if driver and executors are one process; else it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='gridlark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Tasks for each core when a narrow table is written.
WAVES = 4


def stored(df: DataFrame, label: str, *, narrow: bool = False) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    Cuts the lineage with files that outlive any executor, and gives the planner true sizes, so that
    it broadcasts the table only when it is below ``spark.sql.autoBroadcastJoinThreshold``. A ``narrow``
    table has a few numbers for each document at most and is written by ``WAVES`` tasks for each core,
    however many partitions it has.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    out = df.coalesce(WAVES * max(1, spark.sparkContext.defaultParallelism)) if narrow else df
    out.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of a table made by :func:`stored` that nothing reads any more."""
    spark = df.sparkSession
    roots = {f.rpartition("/")[0] for f in df.inputFiles()}
    hadoop = spark._jsc.hadoopConfiguration()
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(hadoop).delete(path, True)


def released(spark: SparkSession) -> None:
    """Lets the session drop the shuffle files of tables that are stored by now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; none if it is null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def texts(batch, name: str = "text") -> list[bytes]:
    """A text column of an Arrow batch as UTF-8 bytes; null gives no bytes."""
    import pyarrow as pa

    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    else:
        column = column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def sliced(batches, rows: int = 256):
    """Arrow batches cut to few rows, so that long texts do not pile up in a worker."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
