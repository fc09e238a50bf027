"""Registered queries against DuckDB on the smallest data."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from coterie.plans import queries as registry

SF = "/root/testdata/sf0.001"


def values(frame):
    number = lambda x: round(float(x), 6) + 0.0 if isinstance(x, (float, decimal.Decimal)) else x
    return sorted(tuple(number(x.item() if hasattr(x, "item") else x) for x in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got) == values(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
