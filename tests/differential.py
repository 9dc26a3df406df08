"""Runs a query and its SQL side by side."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con.execute(sql).df()


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    if isinstance(v, pd.Timestamp) or hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if hasattr(v, "dtype") or isinstance(v, (int, float)):
        return repr(round(float(v), 6) + 0.0) if not hasattr(v, "__len__") else str([cell(x) for x in v])
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted(tuple(cell(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))


def same(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty if both hold the same rows, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for x, y in zip(a, b):
        if x != y:
            return f"{x} and {y}"
    return ""


