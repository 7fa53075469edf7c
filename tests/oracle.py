"""Spark rows against DuckDB rows."""

import glob
import os
from decimal import Decimal

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    return round(value, 9) if isinstance(value, float) else value


def assert_same(df, con, sql):
    found = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    place = [found.columns.index(c) for c in columns]
    want = sorted(str(tuple(_plain(r[k]) for k in place)) for r in found.fetchall())
    got = sorted(str(tuple(_plain(r[c]) for c in columns)) for r in df.collect())
    assert got == want
