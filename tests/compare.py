"""Run a query and its SQL on the same Parquet tables and compare them as bags of rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path / '*.parquet' if path.is_dir() else path}')")
    return con


def plain(v):
    """A value in a form that both engines share; doubles to nine digits."""
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, bytearray | memoryview):
        return bytes(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else 0.0 if v == 0 else float(f"{v:.9g}")
    return v


def bag(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return sorted(df.columns), bag(df.collect(), df.columns)


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return sorted(names), bag(cur.fetchall(), names)


def same(a, b, digits: float = 1e-6) -> bool:
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(same(x, y, digits) for x, y in zip(a, b, strict=True))
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, int | float) and isinstance(b, int | float):
        return abs(a - b) <= digits * max(1, abs(a), abs(b))
    return a == b or str(a) == str(b)


def difference(df, con, sql) -> str:
    """Empty if both give the same rows."""
    names, got = spark_rows(df)
    expected_names, expected = duck_rows(con, sql)
    if names != expected_names:
        return f"columns {names} and {expected_names}"
    if len(got) != len(expected):
        return f"{len(got)} rows and {len(expected)}"
    wrong = [(a, b) for a, b in zip(got, expected, strict=True) if not same(a, b)]
    return f"{len(wrong)} rows differ: {wrong[:3]}" if wrong else ""
