"""Spark rows against DuckDB rows on the smallest tables."""

import math
import os

import pytest

from seamline.plans import data_queries, index_queries, retrieval_queries, table_queries

DATA = "/root/testdata/sf0.001"
MODULES = (retrieval_queries, table_queries, index_queries, data_queries)
NAMES = [(m, n) for m in MODULES for n in m.QUERIES if n in m.SQL]


def plain(v):
    if hasattr(v, "tolist") and not isinstance(v, str):
        v = v.tolist()
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{v:.5f}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("module,name", NAMES, ids=[n for _, n in NAMES])
def test_equals_sql(spark, duck, module, name):
    df = module.QUERIES[name](spark, DATA)
    ours = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = duck.execute(module.SQL[name])
    cols = [d[0] for d in cur.description]
    theirs = sorted(tuple(plain(x) for _, x in sorted(zip(cols, r))) for r in cur.fetchall())
    assert sorted(cols) == sorted(df.columns)
    assert ours == theirs
