"""Compares a query's rows with those of its SQL on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(v: object) -> object:
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") and hasattr(v, "tzinfo") else str(v)


def rows(records: list, columns: list[str], order: list[str]) -> list[str]:
    at = [columns.index(c) for c in order]
    return sorted(repr([plain(r[i]) for i in at]) for r in records)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    cur = con.execute(sql)
    want_columns = [d[0] for d in cur.description]
    order = sorted(df.columns)
    assert order == sorted(want_columns)
    assert rows([tuple(r) for r in df.collect()], df.columns, order) == rows(cur.fetchall(), want_columns, order)
