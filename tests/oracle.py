"""Compares a query with its SQL on DuckDB."""

import math
import os

import duckdb


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in data)


def same(spark, sf_dir, query, sql):
    got = query(spark, sf_dir)
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from read_parquet('{sf_dir}/{f}')")
    want = con.execute(sql)
    expected = rows([d[0] for d in want.description], want.fetchall())
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == expected
