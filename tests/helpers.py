"""Test helpers: DuckDB over the driver tables, order-insensitive compare."""

import math

import duckdb
import numpy as np
import pandas as pd

from telespark.sources.tables import TABLES


def duck(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.sql(sql).df()


def _cell(v, digits):
    if v is None or v is pd.NaT:
        return "<null>"
    if isinstance(v, (float, np.floating)):
        if math.isnan(v):
            return "<null>"
        return repr(round(float(v), digits))
    if isinstance(v, (pd.Timestamp, np.datetime64)):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, (bool, np.bool_)):
        return repr(bool(v))
    if isinstance(v, (int, np.integer)):
        return repr(float(v))
    try:
        if pd.isna(v):
            return "<null>"
    except (TypeError, ValueError):
        pass
    return str(v)


def canon(df: pd.DataFrame, digits: int = 9) -> list:
    cols = sorted(df.columns)
    rows = [tuple(_cell(v, digits) for v in r) for r in df[cols].astype(object).itertuples(index=False)]
    return sorted(rows)


def same(a: pd.DataFrame, b: pd.DataFrame, digits: int = 9) -> bool:
    return sorted(a.columns) == sorted(b.columns) and canon(a, digits) == canon(b, digits)
