"""Every registered query of the library with SQL, against DuckDB on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from brightloom.plans import queries as plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def cell(v):
    if v is None or isinstance(v, (str, bool, datetime.date)):
        return str(v)
    v = float(v)
    return "nan" if math.isnan(v) else f"{v + 0.0:.5f}"


def rows(cols, found):
    at = [cols.index(c) for c in sorted(cols)]
    return sorted(tuple(cell(r[i]) for i in at) for r in found)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    want = duck.sql(plans.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, expected = rows(df.columns, df.collect()), rows(want.columns, want.fetchall())
    assert len(got) == len(expected)
    for g, e in zip(got, expected, strict=True):
        for x, y in zip(g, e, strict=True):
            assert x == y or abs(float(x) - float(y)) <= 2e-5 * max(1, abs(float(y)))


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
