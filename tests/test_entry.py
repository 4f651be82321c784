"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in sorted(v.items()))
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


def table(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(e.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = e.queries()[name](spark, SF)
    got = con.execute(e.oracle_sql()[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    assert table([tuple(r.asDict(True).values()) for r in df.collect()], df.columns) == table(got.fetchall(), cols)


def test_every_sql_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship(spark):
    assert e.entry(spark).count() > 0


def test_core_never_imports_llm():
    for root, _, files in os.walk(os.path.dirname(e.__file__) + "/siftwell"):
        if not root.rstrip("/").endswith("llm"):
            for f in files:
                if f.endswith(".py"):
                    assert "siftwell.llm" not in open(os.path.join(root, f), encoding="utf-8").read()
