"""Every query that SQL can say gives the SQL's rows."""

import glob
import math
import os

import duckdb
import pytest

from strophe.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "null" if math.isnan(x) else f"{x:.9g}"
    return "null" if x is None else str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    rel = duck.sql(SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)
    mine = sorted(tuple(plain(r[c]) for c in cols) for r in got.collect())
    rows = rel.fetchall()
    at = [rel.columns.index(c) for c in cols]
    assert mine == sorted(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, DATA).limit(5).count() > 0
