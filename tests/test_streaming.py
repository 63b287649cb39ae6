"""Streams read from files, batch by batch."""

from gridlark.streaming import triggers

SCHEMA = "key string, step int, value double, at timestamp"


def batches(spark, folder):
    import datetime

    t = datetime.datetime(2024, 1, 1)
    rows = [
        [("a", 1, 1.0, t), ("b", 1, 2.0, t), ("a", 3, 3.0, t)],
        [("a", 2, 9.0, t + datetime.timedelta(hours=1)), ("c", 1, 4.0, t + datetime.timedelta(hours=1))],
        [("b", 5, 5.0, t + datetime.timedelta(hours=3))],
    ]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/part{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_last_row_of_each_key(spark, tmp_path):
    steps = batches(spark, f"{tmp_path}/in")
    triggers.upserted(steps, f"{tmp_path}/out", ["key"], "step", f"{tmp_path}/marks").trigger(availableNow=True).start().awaitTermination()
    got = {r.key: (r.step, r.value) for r in triggers.latest(spark, f"{tmp_path}/out").collect()}
    assert got == {"a": (3, 3.0), "b": (5, 5.0), "c": (1, 4.0)}


def test_totals_by_window(spark, tmp_path):
    totals = triggers.windowed_totals(batches(spark, f"{tmp_path}/in"), "at", ["key"], "value")
    totals.writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = {(r.key, r.start.hour): (r.total, r.n) for r in spark.table("totals").collect()}
    assert got == {("a", 0): (4.0, 2), ("b", 0): (2.0, 1), ("a", 1): (9.0, 1), ("c", 1): (4.0, 1), ("b", 3): (5.0, 1)}
