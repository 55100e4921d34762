"""Compares a query with its SQL on the same tables, ignoring order."""

import decimal
import math
import os
from glob import glob

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def rows(table, columns):
    made = [tuple(plain(r[c]) for c in columns) for r in table.to_pylist()]
    return sorted(made, key=lambda r: tuple((v is None, str(v)) for v in r))


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def same(df, con, sql):
    found = con.sql(sql).arrow()
    found = found.read_all() if hasattr(found, "read_all") else found
    columns = sorted(df.columns)
    assert sorted(found.column_names) == columns
    want, have = rows(found, columns), rows(df.toArrow(), columns)
    assert len(have) == len(want)
    differ = [(h, w) for h, w in zip(have, want) if h != w]
    assert not differ, differ[:3]
