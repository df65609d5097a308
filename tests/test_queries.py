"""Every registered query against its SQL on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from suite.all_queries import COVERS, ORACLES, QUERIES
from suite.check import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLES) <= set(QUERIES) == set(COVERS)
    assert QUERIES.items() <= entry.queries().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert list(got.columns)
    else:
        assert compare(got, duck.execute(sql).df()) == ""
