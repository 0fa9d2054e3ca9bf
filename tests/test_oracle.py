"""Every registered query against its DuckDB oracle on the driver tables (the same
comparison the round driver makes: column names, row count, order-insensitive values)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from lakemart import registry
from tools.check import TABLES, digest

QUERIES, ORACLE = registry.load_all()  # the queries of SURVEY §2; tests/llm has the others


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"create view {t} as select * from read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, sf, con, key):
    df = QUERIES[key](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    r = con.execute(ORACLE[key])
    ocols = [d[0] for d in r.description]
    orows = r.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "order_count" in df.columns
