"""Every registered query against its SQL."""

import pytest

from gridlark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(name, spark, sf_dir, same):
    same(registry.QUERIES[name](spark, sf_dir), registry.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
