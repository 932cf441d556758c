"""Compare a Spark result with the SQL of an independent engine, order ignored."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=_key)


def difference(df, con, sql: str) -> str | None:
    """None if columns and rows agree, else a short description."""
    got = df.collect()
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    want = rel.fetchall()
    a, b = normal_rows(df.columns, got), normal_rows(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, columns {sorted(names)}, first: {bad[0]}"
    return None
