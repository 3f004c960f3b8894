"""Comparison of a query's rows with those of its SQL, without regard to order."""

from __future__ import annotations

import os
from datetime import datetime
from decimal import Decimal

import duckdb


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, Decimal | float):
        return round(float(v), 6)
    if isinstance(v, datetime):
        return str(v)
    return v


def sql_rows(sql: str, tables: dict[str, str]) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name, path in tables.items():
        con.sql(f"create view {name} as select * from '{path}'")
    rel = con.sql(sql)
    names = sorted(rel.columns)
    at = [rel.columns.index(c) for c in names]
    return names, sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def frame_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)


def tables_of(sf_dir: str) -> dict[str, str]:
    out = {}
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}"
        out[f.removesuffix(".parquet")] = f"{path}/*.parquet" if os.path.isdir(path) else path
    return out
