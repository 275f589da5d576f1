"""Every query runs on the smallest tables and equals its oracle there."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "~" if math.isnan(v) else f"{v:.9g}"
    return "~" if v is None else f"{v:.9g}" if isinstance(v, int) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, DIR), duck.execute(ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    assert sorted(got.columns) == columns
    place = [[c[0] for c in want.description].index(c) for c in columns]
    a = sorted(tuple(plain(v) for v in r) for r in got.select(*(f"`{c}`" for c in columns)).collect())
    b = sorted(tuple(plain(r[i]) for i in place) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
