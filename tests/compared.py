"""Spark's rows against DuckDB's."""

import os
from decimal import Decimal

import duckdb

DATA = "/root/testdata"


def plain(x):
    if isinstance(x, (float, Decimal)):
        return round(float(x), 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def connect(sf):
    con = duckdb.connect()
    for f in os.listdir(f"{DATA}/{sf}"):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{sf}/{f}'")
    return con


def same_rows(df, con, sql):
    cols = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    ours = sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    theirs = sorted((tuple(plain(v) for v in r) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)
    assert ours == theirs
