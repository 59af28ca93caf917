"""Order-insensitive comparison of a Spark result with its DuckDB oracle."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from .fixtures import TABLES


def duck_connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir.rstrip('/')}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def canonical(df: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(v) for v in rec) for rec in df[cols].itertuples(index=False, name=None)]
    def key(x):
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return (x is None, repr(float(x)))
        return (x is None, str(x))

    rows.sort(key=lambda r: tuple(key(x) for x in r))
    return cols, rows


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> tuple[bool, str]:
    sc, sr = canonical(spark_pdf)
    dc, dr = canonical(duck_pdf)
    if sc != dc:
        return False, f"columns differ: {sc} vs {dc}"
    if len(sr) != len(dr):
        return False, f"row count {len(sr)} vs {len(dr)}"
    for a, b in zip(sr, dr):
        if a != b:
            return False, f"first differing row:\n spark {a}\n duck  {b}"
    return True, f"{len(sr)} rows match"
