"""Every query with SQL against DuckDB, over the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(entry.core.QUERIES)))
def test_query(spark, db, name):
    got = entry.queries()[name](spark, DATA).toArrow()
    columns = sorted(got.column_names)
    rows = sorted(repr([plain(v) for v in r]) for r in zip(*[got.column(c).to_pylist() for c in columns]))
    assert rows
    if name in entry.oracle_sql():
        want = db.sql(entry.oracle_sql()[name]).to_arrow_table()
        assert sorted(want.column_names) == columns
        assert rows == sorted(repr([plain(v) for v in r]) for r in zip(*[want.column(c).to_pylist() for c in columns]))


def test_entry(spark):
    assert entry.entry(spark).count() == 1
