"""Compares a query with its oracle in DuckDB, as multisets of rows."""

from __future__ import annotations

import os
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """A comparable form of a value: floats to nine significant digits, times as text."""
    if isinstance(value, (float, Decimal)):
        return float(f"{float(value):.9g}") + 0.0
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def oracle_rows(sf_dir, sql):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    found = con.sql(sql)
    return rows_of(found.columns, found.fetchall())


def assert_same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    wanted, want = oracle_rows(sf_dir, sql)
    assert names == wanted
    assert got == want, f"{sum(got.values())} and {sum(want.values())} rows; only ours {list((got - want).items())[:3]}; only the oracle's {list((want - got).items())[:3]}"
