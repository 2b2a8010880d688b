"""Each registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from contigua.plans import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql(f"CREATE VIEW orders AS SELECT * FROM '{DATA}/orders.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, duck, name):
    found = Q.queries()[name](spark, DATA)
    expected = duck.sql(Q.oracle_sql()[name])
    columns = sorted(found.columns)
    assert sorted(expected.columns) == columns
    rows = sorted((tuple(r) for r in found.select(*columns).collect()), key=str)
    assert rows == sorted(expected.select(*columns).fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_other_query(spark, name):
    assert Q.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
