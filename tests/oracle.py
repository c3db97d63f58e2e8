"""Compare a query with its SQL over the same parquet tables."""

from __future__ import annotations

import glob
import os

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _canonical(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(con: duckdb.DuckDBPyConnection, sql: str, df: DataFrame) -> str | None:
    """Why the two results differ, or None."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = _canonical(cur.fetchall(), names)
    got = _canonical([tuple(r) for r in df.collect()], df.columns)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"row {g!r:.600} != {w!r:.600}"
    return None
