"""Every query with SQL agrees with DuckDB on the smallest tables; the others return rows."""

import os

import duckdb
import pytest

from lexloom.plans.registry import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


def plain(v):
    return round(float(v), 6) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in os.listdir(DIR):
        c.sql(f"create view {n[:-8]} as select * from '{DIR}/{n}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in ORACLE_SQL:
        assert got
        return
    r = duck.sql(ORACLE_SQL[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=str)
