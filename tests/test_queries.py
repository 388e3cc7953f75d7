"""Registered queries against DuckDB at the smallest scale."""

import os

import pytest

from tapeworks.plans.queries import QUERIES, SQL

DATA = os.environ.get("QUERY_DATA", "/root/testdata/sf0.001")


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or type(v).__name__ in ("NAType", "NaTType") or v != v:
        return None
    return 0.0 if v == 0 and isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    want, got = con.execute(SQL[name]).df(), QUERIES[name](spark, DATA).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    rows = lambda df: sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)
    assert rows(got) == rows(want)
