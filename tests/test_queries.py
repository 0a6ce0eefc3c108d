"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from gleanwork.plans import catalogue


def cell(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(f"{data}/sf0.001"):
        con.execute(f"create view {f.split('.')[0]} as select * from '{data}/sf0.001/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, data, name):
    df = catalogue.queries()[name](spark, f"{data}/sf0.001")
    cols = sorted(df.columns)
    got = sorted(tuple(cell(x) for x in r) for r in df.select(*cols).collect())
    cur = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(cell(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "company_name" in df.columns
