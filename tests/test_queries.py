"""Every query against its SQL, on stored tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = [tuple(r[c] for c in names) for r in df.collect()]
    assert got
    assert all(not (isinstance(x, float) and math.isnan(x)) for r in got for x in r)
    if name in SQL:
        want = tables.sql(SQL[name])
        assert sorted(want.columns) == names
        order = [want.columns.index(c) for c in names]
        want = [tuple(r[n] for n in order) for r in want.fetchall()]
        assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
