"""Registered queries with a check in SQL give the same rows as DuckDB."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from gaugeworks.sources.views import BASE_TABLES

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in BASE_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    yield connection
    connection.close()


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float) and value == 0:
        value = 0.0
    return repr(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, duck, name):
    frame = entry.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    wanted = sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    assert found == wanted


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
