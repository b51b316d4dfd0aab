"""Compare a Spark result with its SQL twin: column names, row count, values without order."""

from __future__ import annotations

import datetime as dt
import decimal
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def norm(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (int, decimal.Decimal, dt.date, dt.datetime)):
        return value
    raise TypeError(f"unexpected value {value!r} in a flat result")


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def kind(value):
    return None if value is None else type(value).__name__


def difference(df, con, sql: str) -> str | None:
    result = con.execute(sql)
    want_names = [d[0] for d in result.description]
    want_rows = result.fetchall()
    got_rows = df.collect()
    if sorted(df.columns) != sorted(want_names):
        return f"columns {sorted(df.columns)} != {sorted(want_names)}"
    got, want = rows_of(df.columns, got_rows), rows_of(want_names, want_rows)
    if got != want:
        return (
            f"{sum(got.values())} rows against {sum(want.values())}; "
            f"only here {list((got - want).items())[:3]}; only in SQL {list((want - got).items())[:3]}"
        )
    for name in want_names:
        a = {kind(r[name]) for r in got_rows} - {None}
        b = {kind(r[want_names.index(name)]) for r in want_rows} - {None}
        if a != b:
            return f"column {name} is {a} against {b}"
    return None if want_rows else "EMPTY"
