"""Runs queries in Spark and their SQL twins in DuckDB and compares rows without order."""

from __future__ import annotations

import math
from pathlib import Path


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(_norm(x) for x in v.values())
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, query, sql: str, sf_dir: str) -> str | None:
    """None where both give the same columns and rows; else what differs first."""
    got = query(spark, sf_dir)
    con = connect(sf_dir)
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    if sorted(got.columns) != sorted(columns):
        return f"columns {sorted(got.columns)} and {sorted(columns)}"
    a, b = rows_of(got.columns, got.collect()), rows_of(columns, want.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    return next((f"{x} and {y}" for x, y in zip(a, b, strict=True) if x != y), None)
