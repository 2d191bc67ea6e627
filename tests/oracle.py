"""Holds a Spark result against DuckDB's over the same tables."""

import datetime
import decimal
import os

import duckdb


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v) if v % 1 else int(v)
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=str)


def expected(sf: str, sql: str):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    got = con.sql(sql)
    return sorted(got.columns), rows_of(got.columns, got.fetchall())


def same(df, sf: str, sql: str) -> None:
    columns, rows = expected(sf, sql)
    assert sorted(df.columns) == columns
    assert rows_of(df.columns, df.collect()) == rows
