"""Compaction against a plain version, the index against plain first fit, and edge cases."""

import datetime
import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridlark.llm import compaction

SCHEMA = "click_id long, day string, arrived_at timestamp_ntz, file_key int, kind string, value double, lots string, `_metadata` string, name string"
EPOCH = datetime.datetime(1970, 1, 1)


def local(path):
    return path.removeprefix("file://")


def plain(rows, names):
    """rows: (click_id, arrived_at, value)."""
    n = len(rows)
    share = lambda x: 1 + n // x
    days = defaultdict(list)
    for r in rows:
        days[None if r[1] is None else (r[1] - EPOCH).days].append(r)
    out = []
    for day, own in days.items():
        files = defaultdict(list)
        for r in own:
            h = zlib.crc32(str(r[0]).encode()) if r[0] is not None else 0
            files[h // 16 % (1 + len(own) // share(150)), min(h % 4, h // 4 % 4)].append(r)
        for f in files.values():
            f.sort(key=lambda r: (r[1] is not None, r[1] or EPOCH, r[0] is not None, r[0] or 0))
        groups = []
        for k in sorted((k for k in files if len(files[k]) < share(600)), key=lambda k: (-len(files[k]), k)):
            fit = [g for g in groups if sum(len(files[j]) for j in g) + len(files[k]) <= share(400)]
            fit[0].append(k) if fit else groups.append([k])
        for g in groups + [[k] for k in files if len(files[k]) >= share(600)]:
            ids = [r[0] for k in g for r in files[k]]
            known = [i for i in ids if i is not None]
            cents = sum(int(np.floor(100 * r[2] + 0.5)) for k in g for r in files[k] if r[2] is not None and np.isfinite(r[2]))
            text = ",".join("" if i is None else str(i) for i in ids)
            out.append((day, *g[0], len(ids), min(known, default=None), max(known, default=None), cents, ",".join(f"{a}-{b}" for a, b in g), hashlib.sha256(text.encode()).hexdigest(), ",".join(names), len(g) > 1))
    return sorted(out, key=str)


def flat(rows):
    return sorted(((*r[:10], r.rewritten) for r in rows), key=str)


def test_query_on_whole_table(spark, sf_dir):
    from gridlark.llm import queries

    got = queries.QUERIES["op12_compaction"](spark, sf_dir).collect()
    table = pq.read_table(f"{sf_dir}/clicks.parquet")
    rows = list(zip(*(table.column(c).to_pylist() for c in ("click_id", "arrived_at", "value")), strict=True))
    assert flat(got) == plain(rows, table.column_names)
    folder = os.path.dirname(local(got[0].path))
    assert {os.path.basename(r.path) for r in got} == {x for x in os.listdir(folder) if not x.endswith(".crc")}
    assert os.listdir(os.path.dirname(folder)) == ["rows"]
    # no row is lost or changed
    key = lambda t: sorted(map(repr, t.to_pylist()))
    assert key(pq.read_table(folder)) == key(table)
    # a joined file has its sources' rows one after the other, sorted in each
    joined = next(r for r in got if r.rewritten and "," in r.sources)
    at = pq.read_table(local(joined.path)).column("arrived_at").to_pylist()
    assert sum(a > b for a, b in zip(at, at[1:], strict=False)) <= joined.sources.count(",")


def clicks(seed, n, hot):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        day = -3 if rng.random() < hot else rng.randrange(-20, 40)
        at = EPOCH + datetime.timedelta(days=day, seconds=rng.randrange(86400)) if rng.random() < 0.95 else None
        rows.append((rng.choice([None, -i, i, i, i, 7]), at, rng.choice([None, float("nan"), float("inf"), 0.005, -1.335, 12.25, 1e6])))
    return rows + rows[:20]


@pytest.mark.parametrize(("n", "hot"), [(4000, 0.33), (700, 0.9)])
def test_skewed_days_nulls_and_clashing_names(spark, n, hot):
    rows = clicks(n, n, hot)
    df = spark.createDataFrame([(i, "d", at, 1, None, v, "l", "m", "n") for i, at, v in rows], SCHEMA).repartition(3)
    assert flat(compaction.compact(df).collect()) == plain(rows, df.columns)


def test_empty_table_and_new_folders(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert compaction.compact(df).collect() == []
    one = spark.createDataFrame([(1, "d", EPOCH, 1, None, 1.0, "l", "m", "n")], SCHEMA)
    a, b = (compaction.compact(one).collect()[0] for _ in range(2))
    assert a.path != b.path and pq.read_table(local(a.path)).equals(pq.read_table(local(b.path)))


def test_untouched_files_keep_their_bytes(spark, monkeypatch):
    rows = clicks(1, 3000, 0.2)
    df = spark.createDataFrame([(i, "d", at, 1, None, v, "l", "m", "n") for i, at, v in rows], SCHEMA)
    seen, take = {}, compaction._Folder.take

    def spy(self, *args):
        take(self, *args)
        if not seen:
            seen.update({x: hashlib.sha256(open(f"{local(self.path)}/{x}", "rb").read()).digest() for x in os.listdir(local(self.path)) if x.endswith(".parquet")})

    monkeypatch.setattr(compaction._Folder, "take", spy)
    got = compaction.compact(df).collect()
    still = [r for r in got if not r.rewritten]
    assert still and all(seen[os.path.basename(r.path)] == hashlib.sha256(open(local(r.path), "rb").read()).digest() for r in still)


def test_index_is_first_fit():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([1, 2, 7, 8, 100, 1023])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randrange(60))]
        left, want = [], []
        for s in sizes:
            g = next((i for i, x in enumerate(left) if x >= s), len(left))
            if g == len(left):
                left.append(capacity)
            left[g] -= s
            want.append(g)
        assert compaction.first_fit(sizes, capacity) == want


def test_candidates_compare_all_groups():
    index = compaction.ResidualIndex(1000)
    sizes = [random.Random(4).randint(1, 1000) for _ in range(50)]
    for s in sizes:
        index.put(s)
    left = [index.left(g) for g in range(index.size)]
    for need in (0, 1, 500, 999, 1000, 1024, 5000):
        assert index.candidates(need) == sum(1 << g for g, x in enumerate(left) if x >= need)


def test_names_and_keys(spark):
    rows = [(d, lot, p) for d in (None, -719162, -1, 0, 19723, 2932896) for lot in (0, 149) for p in range(4)]
    df = spark.createDataFrame(rows, "d int, lot long, p int")
    got = df.select("d", "lot", "p", compaction.file_key(F.col("d"), F.col("lot"), F.col("p")).alias("k")).select("*", *[c.alias(f"u{i}") for i, c in enumerate(compaction._unpacked(F.col("k")))]).collect()
    assert len({r.k for r in got}) == len(rows)
    for r in got:
        assert (r.u0, r.u1, r.u2) == (r.d, r.lot, r.p) and compaction.file_name(r.k) == f"{'none' if r.d is None else r.d}-{r.lot}-{r.p}"
