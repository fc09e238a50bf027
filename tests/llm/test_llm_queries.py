"""What SQL can say of the text operators, on the smallest data."""

import math

import duckdb
import pytest

from coterie.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = db.sql(registry.ORACLE_SQL[name]).df(), registry.QUERIES[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    order = [c for c in ("doc_id", "page_id", "broken") if c in got.columns]
    got, want = (df[sorted(df.columns)].sort_values(order).reset_index(drop=True) for df in (got, want))
    for column in got.columns:
        for a, b in zip(got[column].tolist(), want[column].tolist(), strict=True):
            assert a == b or isinstance(a, float) and math.isclose(a, b, abs_tol=1.5e-3), column


def test_all_queries_are_registered():
    assert [n.split("_")[0] for n in registry.QUERIES if n.startswith("op")] == [f"op{i}" for i in range(1, 11)]
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
