"""Compares a Spark result with DuckDB's, without regard to the order of rows."""

from __future__ import annotations

import decimal
import glob
import os

import duckdb
import pandas as pd


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return con


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(_plain(v) for v in r) for r in df.itertuples(index=False)), key=lambda r: [(x is None, str(x)) for x in r])


def assert_same(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> None:
    assert sorted(spark_df.columns) == sorted(sql_df.columns)
    a, b = rows(spark_df), rows(sql_df)
    assert len(a) == len(b)
    assert [(x, y) for x, y in zip(a, b) if x != y][:3] == []
