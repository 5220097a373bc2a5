"""Spark result against DuckDB SQL on the same Parquet files: rows in any order, columns by name."""

from __future__ import annotations

import os
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return repr(round(x, 9) + 0.0)
    if isinstance(x, Decimal):
        return repr(float(x))
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, int):
        return str(x)
    if isinstance(x, (date, datetime)):
        return x.isoformat()
    return repr(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str:
    """Empty if equal, else what differs."""
    rel = con.sql(sql)
    names, want = rows_of(list(rel.columns), rel.fetchall())
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if names != got_names:
        return f"columns {got_names} against {names}"
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return f"{len(got)} rows against {len(want)}; only Spark {sorted(a)[:3]}; only SQL {sorted(b)[:3]}"
    return ""
