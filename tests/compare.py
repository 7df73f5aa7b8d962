"""Side-by-side comparison of a Spark result with the DuckDB check statement."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os

import duckdb

DUCK_NAMES = {"string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "int": "INTEGER"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _canon(v):
    if isinstance(v, float):
        return None if v != v else float(repr(v)) + 0.0
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return v


def rows_of(records) -> list[tuple]:
    return sorted((tuple(_canon(v) for v in r) for r in records), key=repr)


def differences(spark, con, query, sf_dir: str) -> list[str]:
    df = query.run(spark, sf_dir)
    spark_rows = rows_of(tuple(r) for r in df.collect())
    cur = con.execute(query.oracle())
    names = [d[0] for d in cur.description]
    kinds = [str(d[1]) for d in cur.description]
    duck_rows = rows_of(cur.fetchall())
    out = []
    if names != df.columns:
        out.append(f"columns {df.columns} vs {names}")
    for field, kind in zip(df.dtypes, kinds):
        want = DUCK_NAMES.get(field[1], field[1].upper())
        if want != kind.upper():
            out.append(f"type of {field[0]}: {want} vs {kind}")
    if len(spark_rows) != len(duck_rows):
        out.append(f"rows {len(spark_rows)} vs {len(duck_rows)}")
    bad = [(a, b) for a, b in zip(spark_rows, duck_rows) if a != b]
    if bad:
        out.append(f"{len(bad)} rows differ, first {bad[0][0]} vs {bad[0][1]}")
    if not spark_rows:
        out.append("EMPTY")
    return out
