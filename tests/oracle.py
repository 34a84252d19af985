"""Rows of a query and of its SQL in DuckDB, in one form."""

import datetime

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float | np.number):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(str(tuple(plain(r[c]) for c in names)) for r in df.collect())


def duck_rows(sql, folder, tables=TABLES):
    c = duckdb.connect()
    for t in tables:
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    rel = c.sql(sql)
    cols, names = list(rel.columns), sorted(rel.columns)
    return names, sorted(str(tuple(plain(r[cols.index(k)]) for k in names)) for r in rel.fetchall())
