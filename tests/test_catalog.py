"""The driver's contract."""

import pytest

import __spark_entry__ as entry
from specloom.plans import catalog


def test_names_match():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and all(callable(f) for f in q.values())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() >= 0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, sf, name):
    import math
    import os

    import duckdb

    def plain(v):
        return round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v

    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf}/{f}')")
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in res.fetchall())
    assert got == want
