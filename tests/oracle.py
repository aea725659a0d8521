"""Running a query's checking SQL in DuckDB, and comparing results as multisets."""

import decimal
import math
import numbers
import os

import duckdb

from rillframe.sources.tables import NAMES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in NAMES:
        path = f"{folder}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _cell(value):
    if value is None or isinstance(value, float) and not math.isfinite(value) or str(value) in ("<NA>", "NaT"):
        return "null"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, numbers.Integral) or isinstance(value, (float, decimal.Decimal)) and value == int(value):
        return str(int(value))
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.9e}"  # ten digits: sums of doubles differ in their last places
    return str(value)


def rows(frame) -> list:
    names = sorted(frame.columns)
    return sorted(tuple(_cell(v) for v in row) for row in frame[names].itertuples(index=False))
