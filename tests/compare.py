"""A query's rows against DuckDB's rows for its SQL."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.9g}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(_value, x)) + "]"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def _rows(names, rows) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_value(r[i]) for i in order) for r in rows)


def difference(df, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """'' if both have the same columns and rows, else what differs."""
    got = _rows(df.columns, df.collect())
    cur = con.execute(sql)
    want = _rows([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} instead of {want[0]}"
    if got[1] == want[1]:
        return ""
    more, less = sorted(set(got[1]) - set(want[1])), sorted(set(want[1]) - set(got[1]))
    return f"{len(got[1])} rows instead of {len(want[1])}; unwanted {more[:3]}, missing {less[:3]}"
