"""Every query with an oracle gives what DuckDB gives on the smallest tables; the others run and have rows."""

import math
import os

import duckdb
import pytest

from cairn.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in catalog.oracle_sql():
        assert got
        return
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [list(want.columns).index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_entry_runs(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(0 <= r["low"] <= r["commit_rate"] <= r["high"] <= 1 for r in rows)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
