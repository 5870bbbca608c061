"""Compare a Spark result with a DuckDB result, independent of row and column order."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, (str, bytes, dt.datetime, dt.date)):
        return (0, "") if value is None else (1, str(value))
    if isinstance(value, bool):
        return (2, int(value))
    if isinstance(value, (int, float, decimal.Decimal)):
        value = float(value)
        return (3, "nan") if math.isnan(value) else (2, round(value, 5) + 0.0)
    if isinstance(value, (list, tuple)):
        return (4, str([plain(v) for v in value]))
    return (5, str(value))


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql: str):
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def difference(got, want) -> str | None:
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}; first {got[1][:2]} / {want[1][:2]}"
    for a, b in zip(got[1], want[1]):
        if a != b and any(
            x != y and not (x[0] == y[0] == 2 and abs(x[1] - y[1]) <= 2e-5) for x, y in zip(a, b)
        ):
            return f"{a} != {b}"
    return None
