import pytest

from tests.oracle import compare
from veilframe import catalog

SQL = catalog.oracle_sql()
#: Queries that train models or draw fresh noise have no SQL.
FREE = sorted(set(catalog.queries()) - set(SQL))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, name):
    assert compare(spark, catalog.queries()[name], SQL[name], sf_dir) > 0


@pytest.mark.parametrize("name", FREE)
def test_has_rows(spark, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
