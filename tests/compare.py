"""Run a query in Spark and its oracle in DuckDB and compare the rows."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def differences(spark_df, con, sql: str) -> str:
    """Empty text if both sides agree, else what differs."""
    left = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} | {right[0]}"
    if left[1] == right[1]:
        return ""
    a, b = set(map(repr, left[1])), set(map(repr, right[1]))
    return (
        f"rows {len(left[1])} | {len(right[1])}; only spark {len(a - b)}, only oracle {len(b - a)}\n"
        f"  spark:  {sorted(a - b)[:2]}\n  oracle: {sorted(b - a)[:2]}"
    )
