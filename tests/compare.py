"""Compare a registered query with its SQL check in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from larkspur.plans.domain import BASE_TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _norm(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return ("dec", round(float(value), 6))
    if isinstance(value, float):
        return None if math.isnan(value) else ("float", round(value, 6) + 0.0)
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def differences(spark, sf_dir: str, fn, sql: str, con=None) -> str | None:
    """None when both engines agree, else a short report."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    con = con or duck(sf_dir)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; spark-only {[r for r in got if r not in set(want)][:2]} duck-only {[r for r in want if r not in set(got)][:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, columns {sorted(names)}: {bad[:2]}"
    if not got:
        return "EMPTY"
    return None
