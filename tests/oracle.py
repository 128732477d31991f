"""Compare registered queries with their oracle SQL: row count, columns and values, order-insensitive."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads=4")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        if isinstance(value, float) and math.isnan(value):
            return (2, "nan")
        return (3, repr(float(value)))
    return (4, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, otherwise a short description."""
    mine = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    other = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if mine[0] != other[0]:
        return f"columns differ: {mine[0]} / {other[0]}"
    if len(mine[1]) != len(other[1]):
        return f"row counts differ: {len(mine[1])} / {len(other[1])}"
    wrong = [(a, b) for a, b in zip(mine[1], other[1]) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(mine[1])} rows differ, first: {wrong[0]}"
    return None
