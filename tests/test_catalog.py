"""Every registered query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from fabrel.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    d = duckdb.connect()
    for f in os.listdir(sf):
        d.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return d


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, sf, name):
    ours, theirs = QUERIES[name](spark, sf).toArrow(), duck.sql(ORACLE_SQL[name]).to_arrow_table()
    cols = sorted(ours.column_names)
    assert cols == sorted(theirs.column_names)
    rows = lambda t: sorted(str([r[c] for c in cols]) for r in t.to_pylist())
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
