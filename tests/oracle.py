"""Comparison of a query with its SQL in DuckDB."""

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if v != v else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, (bool, int, str, bytes)) else str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.select(*cols).collect()), key=str)


def rows_of_sql(c, sql):
    r = c.sql(sql)
    cols = sorted(r.columns)
    at = [r.columns.index(x) for x in cols]
    return cols, sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=str)
