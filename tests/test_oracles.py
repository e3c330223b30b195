"""Every core query with an oracle gives DuckDB's rows."""

import math
import os

import duckdb
import pytest

from umbra import queries

SF = os.environ.get("UMBRA_TEST_SF", "/root/testdata/sf0.001")


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    clean = lambda v: round(v, 5) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations"):
        con.sql(f"CREATE VIEW {table} AS FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
