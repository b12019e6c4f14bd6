"""Run a query on Spark and its SQL on DuckDB, and compare rows without regard to order."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, rows) -> Counter:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in at) for row in rows)


def differences(spark, con, query, sql, folder, most=4) -> list[str]:
    df = query(spark, folder)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns differ: {sorted(df.columns)} / {sorted(names)}"]
    kinds = {c: str(t) for c, t in zip(names, [d[1] for d in result.description])}
    ours = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP",
            "boolean": "BOOLEAN"}
    wrong = [f"{c}: {t} / {kinds[c]}" for c, t in df.dtypes if ours.get(t) != kinds[c]]
    if wrong:
        return ["types differ: " + ", ".join(wrong)]
    left, right = rows_of(df.columns, df.collect()), rows_of(names, result.fetchall())
    if not left:
        return ["no rows"]
    if left == right:
        return []
    only_left, only_right = left - right, right - left
    return [f"{sum(left.values())} / {sum(right.values())} rows, {sum(only_left.values())} differ"] + [
        f"spark {row}" for row in sorted(only_left, key=str)[:most]
    ] + [f"sql   {row}" for row in sorted(only_right, key=str)[:most]]
