"""Hold a query's rows against its SQL on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb
from pyspark.sql import DataFrame

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows_of(df: DataFrame) -> list[str]:
    columns = sorted(df.columns)
    return sorted(repr(tuple(r[c] for c in columns)) for r in df.select(*columns).collect())


def oracle_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[str]]:
    table = con.execute(sql).to_arrow_table()
    columns = sorted(table.column_names)
    return columns, sorted(repr(tuple(r[c] for c in columns)) for r in table.select(columns).to_pylist())
