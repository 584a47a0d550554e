"""Compares a Spark result with DuckDB's on the same tables."""

from __future__ import annotations

import glob

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {p.rsplit('/', 1)[-1][:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0  # NaN stays unequal to NaN
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


def compare(spark, f, sql: str, sf_dir: str) -> None:
    df = f(spark, sf_dir)
    got = rows(df.columns, df.collect())
    r = connect(sf_dir).execute(sql)
    columns = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows(columns, r.fetchall())
