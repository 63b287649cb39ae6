"""Executed compaction: small files are packed first-fit by a bit-sliced index of what groups have left.

A table is written as starting files, one for each (day, lot, piece), and then compacted where it lies. Of the ``R``
rows, ``share(x) = 1 + floor(R / x)``. A row's day is its arrival in whole days since 1970, and ``h`` the CRC-32 of
its decimal id. In a day of ``r`` rows, ``lot = floor(h / 16) % (1 + floor(r / share(150)))`` and
``piece = min(h % 4, floor(h / 4) % 4)``. A file has its rows in order of arrival and id.

Files under ``share(600)`` rows are packed day by day: by descending rows, then lot, then piece, each joins the
earliest-opened group that holds at most ``share(400)`` rows with it, or opens one. What the groups have left is kept in
bit-planes: bit ``g`` of plane ``b`` is bit ``b`` of what group ``g`` has left, one large integer for each plane. One pass
over the planes from the top compares all groups with a file at once; the lowest bit set in the outcome is the first
group that holds it. A day has at most 4 * 150 starting files, as a day with ``share(150)`` rows or more (fewer than 150
are) has a lot for each such share; so a day's packing is bounded, and days are packed in parallel.

Each starting file and each group of several is a file that must be whole, so one task writes it; the rows come to it
sorted, through Spark's sorter, which spills, and stream into the file. All other work is dealt out: counts are combined
by task, only the members of groups are read again, and digests are streamed by file. A row's place in a group is its
source's place and its place in that file. Tables of days and files go by plain joins, except for the days of several
lots, which are fewer than 150 and are broadcast. The driver renames finished files into the folder and deletes
replaced ones, as a committer does: names only, at most 4 * (days + 150), and no rows.

Every call makes a new folder. Groups are written aside, renamed into place, and only then are their sources deleted,
so a lost task or executor is repeated from files that are still there.

Null arrivals are a day of their own (null); a null id has ``h`` 0 and is an empty string in the list of ids. Null, NaN
and infinite values count 0 cents. Repeated rows are rows. An empty table gives no files and no rows. All columns of the
table are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored

LOT_SHARE, SMALL_SHARE, GROUP_SHARE = 150, 600, 400
#: Stands for the null day in keys; no date has it.
NO_DAY = -(1 << 31)
RESULT = "day long, lot long, piece long, n_rows long, min_click_id long, max_click_id long, cents long, sources string, ids_sha256 string, columns string, path string, rewritten boolean"


class ResidualIndex:
    """What groups have left, by bit-planes over the groups."""

    def __init__(self, capacity: int):
        self.capacity, self.size = capacity, 0
        self.planes = [0] * capacity.bit_length()

    def left(self, group: int) -> int:
        return sum((p >> group & 1) << b for b, p in enumerate(self.planes))

    def candidates(self, need: int) -> int:
        """A bit for each group that has at least ``need`` left."""
        if need >> len(self.planes):
            return 0
        more, equal = 0, (1 << self.size) - 1
        for b in reversed(range(len(self.planes))):
            if need >> b & 1:
                equal &= self.planes[b]
            else:
                more |= equal & self.planes[b]
                equal &= ~self.planes[b]
        return more | equal

    def put(self, need: int) -> int:
        """The first group that holds a file of ``need`` rows; a new one if there is none."""
        found = self.candidates(need)
        if found:
            group = (found & -found).bit_length() - 1
            left = self.left(group) - need
        else:
            group, left = self.size, self.capacity - need
            self.size += 1
        bit = 1 << group
        for b in range(len(self.planes)):
            self.planes[b] = self.planes[b] | bit if left >> b & 1 else self.planes[b] & ~bit
        return group


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """The group of each file, in the given order; every size is the capacity at most."""
    index = ResidualIndex(capacity)
    return [index.put(n) for n in sizes]


def share(rows: int, x: int) -> int:
    return 1 + rows // x


def day_of(at: Column) -> Column:
    return F.unix_date(at.cast("date"))


def file_key(day: Column, lot: Column, piece: Column) -> Column:
    """Day, lot and piece in one number: 2 bits for the piece, 10 for the lot."""
    return F.shiftleft(F.coalesce(day, F.lit(NO_DAY)).cast("long"), 12) + F.shiftleft(lot.cast("long"), 2) + piece


def file_name(key: int) -> str:
    day = key >> 12
    return f"{'none' if day == NO_DAY else day}-{key >> 2 & 1023}-{key & 3}"


def _unpacked(key: Column) -> list[Column]:
    day = F.shiftright(key, 12)
    return [F.when(day != NO_DAY, day).alias("day"), F.shiftright(key, 2).bitwiseAND(1023).alias("lot"), key.bitwiseAND(3).alias("piece")]


class _Folder:
    """A folder of finished files, and what is written aside."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.base = f"{shared_dir(self.spark).rstrip('/')}/compacted-{uuid.uuid4().hex}"
        self.path = f"{self.base}/rows"
        self.jvm = self.spark._jvm.org.apache.hadoop.fs
        self.fs = self.jvm.Path(self.base).getFileSystem(self.spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.jvm.Path(self.path))

    def take(self, df: DataFrame, key: str, suffix: str = "") -> None:
        """Writes one file for each value of a column of whole numbers, in the order of the rows."""
        aside = f"{self.base}/aside"
        df.write.option("maxRecordsPerFile", 0).partitionBy(key).parquet(aside)
        for found in self.fs.listStatus(self.jvm.Path(aside)):
            if found.isDirectory():
                (file,) = [x.getPath() for x in self.fs.listStatus(found.getPath()) if x.getPath().getName().startswith("part-")]
                to = self.jvm.Path(f"{self.path}/{file_name(int(found.getPath().getName().partition('=')[2]))}{suffix}.parquet")
                if not self.fs.rename(file, to):
                    raise OSError(f"cannot rename {file.toString()} to {to.toString()}")
        self.fs.delete(self.jvm.Path(aside), True)

    def drop(self, names: list[str]) -> None:
        for name in names:
            self.fs.delete(self.jvm.Path(f"{self.path}/{name}"), False)


def _free(columns: list[str], name: str) -> str:
    """A name that the table does not have."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def starting_files(df: DataFrame, folder: _Folder, rows: int, days: DataFrame, at: str, id_: str) -> None:
    """Writes a sorted file for each (day, lot, piece)."""
    key, lots = _free(df.columns, "file_key"), _free(df.columns, "lots")
    several = days.filter((F.col("r") >= share(rows, LOT_SHARE)) & F.col("d").isNotNull()).select("d", (1 + F.floor(F.col("r") / share(rows, LOT_SHARE))).alias(lots))  # fewer than 150 rows
    none = days.filter(F.col("d").isNull()).first()  # one row at most
    lots_of_none = 1 + none["r"] // share(rows, LOT_SHARE) if none else 1
    h = F.coalesce(F.crc32(F.col(id_).cast("string")), F.lit(0))
    lot = F.floor(h / 16) % F.coalesce(F.col(lots), F.when(F.col(at).isNull(), F.lit(lots_of_none)), F.lit(1))
    piece = F.least(h % 4, F.floor(h / 4) % 4)
    x = df.join(F.broadcast(several), day_of(F.col(at)) == F.col("d"), "left").select(*[df[c] for c in df.columns], file_key(day_of(F.col(at)), lot, piece).alias(key))
    folder.take(x.repartition(key).sortWithinPartitions(key, at, id_), key)


def packed(files: DataFrame, rows: int) -> DataFrame:
    """key and n of the starting files -> key, first (the first key of its group), place, members."""
    small, capacity = share(rows, SMALL_SHARE), share(rows, GROUP_SHARE)

    def day(part):
        import pandas as pd

        part = part[part["n"] < small].sort_values(["n", "key"], ascending=[False, True])  # within a day, a key is in the order of lot and piece
        group = np.array(first_fit(part["n"].tolist(), capacity), np.int64)
        out = pd.DataFrame({"key": part["key"].to_numpy(np.int64), "group": group})
        of = out.groupby("group", sort=False)["key"]
        return out.assign(first=of.transform("first"), place=of.cumcount(), members=of.transform("size"))[["key", "first", "place", "members"]].astype("int64")

    return files.groupBy(F.shiftright("key", 12).alias("d")).applyInPandas(day, "key long, first long, place long, members long")


def digests(folder: str, spark, id_: str, value: str) -> DataFrame:
    """name, n_rows, smallest and largest id, cents and the digest of the ids in file order, of each file."""
    schema = "name string, n_rows long, min_click_id long, max_click_id long, cents long, ids_sha256 string"
    x = spark.read.parquet(folder)
    meta = x.metadataColumn("_metadata")
    rows = x.select(meta["file_name"].alias("name"), meta["row_index"].alias("at"), F.col(id_).cast("long").alias("id"), F.col(value).cast("double").alias("value"))

    def kernel(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        open_: dict = {}

        def out():
            sha = open_.pop("sha").hexdigest()
            return pa.RecordBatch.from_pylist([open_ | {"ids_sha256": sha}], pa.schema([("name", pa.string()), *[(c, pa.int64()) for c in ("n_rows", "min_click_id", "max_click_id", "cents")], ("ids_sha256", pa.string())]))

        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.nonzero(names[1:] != names[:-1])[0] + 1).tolist(), len(names)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if open_.get("name") != names[a]:
                    if open_:
                        yield out()
                    open_ = {"name": names[a], "n_rows": 0, "min_click_id": None, "max_click_id": None, "cents": 0, "sha": hashlib.sha256()}
                ids = batch.column(2).slice(a, b - a)
                text = ",".join(["" if i is None else str(i) for i in ids.to_pylist()])
                open_["sha"].update((text if not open_["n_rows"] else "," + text).encode())
                for name, end, pick in (("min_click_id", "min", min), ("max_click_id", "max", max)):
                    known = [i for i in (open_[name], pc.min_max(ids)[end].as_py()) if i is not None]
                    open_[name] = pick(known) if known else None
                v = batch.column(3).slice(a, b - a).fill_null(0).to_numpy(zero_copy_only=False)
                with np.errstate(over="ignore"):
                    cents = np.floor(100 * np.where(np.isfinite(v), v, 0) + 0.5)
                open_["cents"] += int(cents.astype(np.int64).sum()) if (np.abs(cents) < 2.0**40).all() else sum(int(c) for c in cents.tolist() if np.isfinite(c))
                open_["n_rows"] += b - a
        if open_:
            yield out()

    return rows.repartition("name").sortWithinPartitions("name", "at").mapInArrow(kernel, schema)


def compact(df: DataFrame, *, at: str = "arrived_at", id_: str = "click_id", value: str = "value") -> DataFrame:
    """Writes and compacts a table; a row for each final file.

    ``day``, ``lot`` and ``piece`` are those of a file's first source, ``sources`` are ``lot-piece`` in joining order, and
    ``cents`` adds up ``floor(100 * value + 0.5)``.
    """
    spark = df.sparkSession
    folder = _Folder(df)
    days = stored(df.groupBy(day_of(F.col(at)).alias("d")).agg(F.count(F.lit(1)).alias("r")), "compaction-days", narrow=True)
    rows = days.agg(F.sum("r")).first()[0] or 0
    if not rows:
        return spark.createDataFrame([], RESULT)
    starting_files(df, folder, rows, days, at, id_)
    start = spark.read.parquet(folder.path)
    name = start.metadataColumn("_metadata")["file_name"]
    parts = F.split(F.regexp_replace(name, r"\.parquet$", ""), "-(?=[0-9]+-[0-9]+$)|-(?=[0-9]+$)")
    key = file_key(F.when(parts[0] != "none", parts[0].cast("long")), parts[1].cast("long"), parts[2].cast("long"))
    files = stored(start.select(name.alias("name"), key.alias("key")).groupBy("name", "key").agg(F.count(F.lit(1)).alias("n")), "compaction-files", narrow=True)
    plan = stored(packed(files, rows), "compaction-plan", narrow=True)
    joined = stored(plan.filter("members > 1").join(files, "key").select("name", "first", "place"), "compaction-joined", narrow=True)
    members = [r["name"] for r in joined.select("name").collect()]  # names of files, at most 4 * (days + 150)
    if members:
        old = spark.read.parquet(folder.path)
        meta = old.metadataColumn("_metadata")
        old = old.filter(meta["file_name"].isin(members))  # other files are not opened
        first, place, row, source = (_free(df.columns, c) for c in ("group_key", "place", "row", "source_file"))
        which = joined.select(F.col("name").alias("m_name"), F.col("first").alias(first), F.col("place").alias(place))
        own = old.select("*", meta["file_name"].alias(source), meta["row_index"].alias(row))
        new = own.join(which, own[source] == F.col("m_name")).select(*[own[c] for c in df.columns], first, place, row)
        folder.take(new.repartition(first).sortWithinPartitions(first, place, row).drop(place, row), first, "-joined")
        folder.drop(members)
    label = F.concat_ws("-", F.shiftright("key", 2).bitwiseAND(1023), F.col("key").bitwiseAND(3))
    source = files.join(plan.filter("members > 1").select("key", "first", "place"), "key", "left").select("key", F.coalesce("first", "key").alias("first"), F.coalesce("place", F.lit(0)).alias("place"), F.col("first").isNotNull().alias("rewritten"), label.alias("label"))
    # a group has one day's files
    groups = source.groupBy("first", "rewritten").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "label"))), lambda s: s["label"]), ",").alias("sources"))
    name = F.concat(F.coalesce(F.nullif(F.shiftright("first", 12), F.lit(NO_DAY)).cast("string"), F.lit("none")), F.lit("-"), F.shiftright("first", 2).bitwiseAND(1023), F.lit("-"), F.col("first").bitwiseAND(3), F.when(F.col("rewritten"), "-joined").otherwise(""), F.lit(".parquet"))
    groups = stored(groups.select(*_unpacked(F.col("first")), "sources", "rewritten", name.alias("g_name")), "compaction-groups", narrow=True)
    done = digests(folder.path, spark, id_, value).join(groups, F.col("name") == F.col("g_name"))
    columns = F.lit(",".join(df.columns)).alias("columns")
    return done.select("day", "lot", "piece", "n_rows", "min_click_id", "max_click_id", "cents", "sources", "ids_sha256", columns, F.concat(F.lit(f"{folder.path}/"), "name").alias("path"), "rewritten")
