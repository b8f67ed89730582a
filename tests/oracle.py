"""Run a registered query and its SQL side by side."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb

TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER", "date": "DATE",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v


def _rows(rows, order):
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql) -> str | None:
    """None when equal, else what differs."""
    mine = df.collect()
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    types = {n: str(t) for n, t in zip(names, [c[1] for c in cur.description])}
    wrong = [f"{n}: {t} vs {types[n]}" for n, t in df.dtypes if TYPES.get(t) != types[n]]
    cols = sorted(names)
    a = _rows(mine, [df.columns.index(c) for c in cols])
    b = _rows(theirs, [names.index(c) for c in cols])
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ in {cols}: {str(bad[0])[:900]}"
    if wrong:
        return f"types {wrong}"
    return None
