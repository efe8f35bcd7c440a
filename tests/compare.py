"""Holds registered queries against their SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v) if isinstance(v, datetime.date) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def both(spark, query, sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    wanted = rows_of(names, got.fetchall())
    df = query(spark, folder)
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    return rows_of(df.columns, [tuple(r) for r in df.collect()]), wanted
