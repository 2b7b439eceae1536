"""Rows of a Spark query and of its SQL in DuckDB, made comparable."""

import datetime
import decimal
import glob
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v


def key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=key)


def of_duckdb(con, sql):
    found = con.execute(sql)
    have = [d[0] for d in found.description]
    names = sorted(have)
    at = [have.index(c) for c in names]
    return names, sorted((tuple(norm(r[i]) for i in at) for r in found.fetchall()), key=key)
