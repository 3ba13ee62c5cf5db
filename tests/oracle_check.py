"""Runs a query on Spark and its SQL on DuckDB over the same tables, and compares all rows."""

import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, int) and not isinstance(value, bool):
        return f"{float(value):.6g}" if abs(value) < 1e5 else str(value)
    return "null" if value is None else str(value)


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


def check(spark, query, sql):
    df = query(spark, DATA)
    c = connect()
    found = c.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(found.columns, found.fetchall())
