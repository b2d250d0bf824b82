"""Compares a query's rows with its SQL on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, list | tuple):
        return tuple(_plain(x) for x in v)
    return str(v) if v is not None and not isinstance(v, bool | int | str) else v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both give the same rows, else what differs first."""
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want, have = rows_of(names, got.fetchall()), rows_of(df.columns, df.collect())
    if len(want) != len(have):
        return f"{len(have)} rows, the SQL gives {len(want)}"
    for a, b in zip(have, want, strict=True):
        if a != b:
            return f"{a} and {b} of columns {sorted(names)}"
    return None
