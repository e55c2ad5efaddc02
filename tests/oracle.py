"""Compares a query's rows with its SQL's in DuckDB."""

import os

import duckdb

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("<null>" if x is None or x != x else str(x) for x in r) for r in df.itertuples(index=False))


def compare(spark, query, sql, sf=SF):
    c = duckdb.connect()
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            c.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    got, want = query(spark, sf).toPandas(), c.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
