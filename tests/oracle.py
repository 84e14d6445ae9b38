"""Compares a Spark result with DuckDB's for the same tables."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

from siftmill.sources.tables import TABLES


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def compare(df, sql: str, sf_dir: str) -> int:
    """Asserts equal columns and equal bags of rows; returns the number of rows."""
    con = connection(sf_dir)
    cur = con.execute(sql)
    theirs_cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(theirs_cols), (df.columns, theirs_cols)
    cols = sorted(df.columns)
    theirs = sorted(repr(tuple(plain(r[theirs_cols.index(c)]) for c in cols)) for r in cur.fetchall())
    ours = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    for a, b in zip(ours, theirs):
        assert a == b, f"\n{a}\n{b}"
    return len(ours)
