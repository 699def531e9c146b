"""Compare a Spark result with DuckDB's result of the SQL that states the same."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def views(folder: Path = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in folder.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: "null" if v is None else (f"{float(v):.5f}" if not isinstance(v, (str, bool, bytes)) else str(v))
    return sorted("|".join(value(r[i]) for i in order) for r in rows)


def same(spark, query, sql: str) -> None:
    got = query(spark, str(DATA))
    want = views().sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.columns, got.collect()) == plain(want.columns, want.fetchall())
