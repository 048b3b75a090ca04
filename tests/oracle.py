"""Compare a query with its SQL counterpart in DuckDB."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if isinstance(v, list):
        return tuple(_plain(x) for x in v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def differences(df, con, sql) -> list[str]:
    """What differs between the Spark result and the SQL result; empty when equal."""
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.sql(sql)
    want = _rows(result.columns, result.fetchall())
    found = []
    if sorted(df.columns) != sorted(result.columns):
        found.append(f"columns {sorted(set(df.columns) ^ set(result.columns))}")
    if len(got) != len(want):
        found.append(f"rows {len(got)} != {len(want)}")
    if found:
        return found
    names = sorted(df.columns)
    bad = {}
    for g, w in zip(got, want):
        for n, a, b in zip(names, g, w):
            if a != b or isinstance(a, float) != isinstance(b, float):
                bad.setdefault(n, []).append((a, b))
    return [f"{n}: {len(v)} rows, e.g. {v[:3]}" for n, v in bad.items()]
