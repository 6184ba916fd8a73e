"""Spark result against DuckDB result, as sorted rows by sorted column names."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def key(row):
    return [(x is not None, type(x).__name__, str(x)) for x in row]


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(x) for x in r) for r in df.select(*names).collect()), key=key)


def duck_rows(con, sql):
    rel = con.sql(sql)
    names = sorted(rel.columns)
    at = [rel.columns.index(n) for n in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)
