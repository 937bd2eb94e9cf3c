"""Every query against its SQL in DuckDB on the smallest tables; those without SQL give rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.plans.QUERIES]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else f"{v:.9g}"
    return v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in entry.plans.SQL:
        assert got
        return
    cur = duck.execute(entry.plans.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    assert got == want


def test_entry_is_a_query_with_rows(spark):
    assert entry.entry(spark).count() > 0


def test_filter_and_columns_reach_the_scan(spark):
    plan = entry.plans.QUERIES["momentum_grid"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "user_id" not in plan
