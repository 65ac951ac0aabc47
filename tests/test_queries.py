"""Every registered query against its SQL on the smallest data, all rows and values."""

import duckdb
import pytest

import __spark_entry__ as spark_entry
from tideline.queries import REGISTERED
from tests.conftest import SMALL
from tools.check import TABLES, rows_of

QUERIES = {name: item.build for name, item in REGISTERED.items()}
SQL = {name: item.sql for name, item in REGISTERED.items() if item.sql is not None}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


def test_all_sql_belongs_to_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
    assert set(QUERIES) <= set(spark_entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    frame = spark_entry.entry(spark)
    assert frame.columns == ["ticker", "window_start", "open", "high", "low", "close", "volume", "n"]
    assert frame.count() > 0
