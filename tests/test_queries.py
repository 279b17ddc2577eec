"""Every registered query against its SQL, on the smallest test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = duck.execute(sql)
    sql_names, expected = rows_of([d[0] for d in found.description], found.fetchall())
    assert names == sql_names and got == expected


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "days_since_last_order" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
