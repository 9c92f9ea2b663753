"""Runs registered queries and their SQL side by side."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA, sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def _plain(v: object) -> object:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, dt.datetime):
        return v.astimezone(dt.timezone.utc).replace(tzinfo=None) if v.tzinfo else v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows(columns: list[str], data: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    from pyspark.sql import functions as F

    stamps = [c for c, t in df.dtypes if t == "timestamp"]  # compared as microseconds, so no time zone plays a part
    df = df.withColumns({c: F.unix_micros(c) for c in stamps})
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    con.execute(f"CREATE OR REPLACE TEMP TABLE result_ AS {sql}")
    con.execute("SELECT column_name, data_type FROM duckdb_columns() WHERE table_name = 'result_' ORDER BY column_index")
    columns = con.fetchall()
    names = [c for c, _ in columns]
    con.execute("SELECT " + ", ".join(f'epoch_us("{c}")' if t.startswith("TIMESTAMP") else f'"{c}"' for c, t in columns) + " FROM result_")
    return sorted(names), rows(names, con.fetchall())
