import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    """Rows as sorted tuples, doubles rounded."""

    def one(v):
        if v is None or v != v:
            return None
        return round(float(v), 6) + 0.0 if isinstance(v, float) else int(v) if isinstance(v, int) else str(v)

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same(duck):
    def check(df, sql):
        names = sorted(df.columns)
        got = plain(df.select(*names).collect())
        rel = duck.execute(f"SELECT {', '.join(names)} FROM ({sql})")
        assert got == plain(rel.fetchall())

    return check
