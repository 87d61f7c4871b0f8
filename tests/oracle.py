"""Compares a query with its SQL."""

import math
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return None if v is None else str(v)


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


def same(spark, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = connection(sf_dir).execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(norm(dict(zip(names, r))[c]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want
