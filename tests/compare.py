"""Order-free comparison of a Spark result with the checking engine's."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd


def normal(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item") and not hasattr(value, "__len__"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if type(value).__name__ == "Decimal":
        return float(value)
    if isinstance(value, (int, float)):
        return float(f"{float(value):.10g}")
    return str(value)


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    rows = [tuple(normal(v) for v in row) for row in frame[columns].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db
