"""Compare a Spark result with its SQL oracle: names, row count and every value."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, Decimal)):
        v = float(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def normal(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None when both agree, else what differs."""
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    expected = normal(names, found.fetchall())
    actual = normal(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    if actual == expected:
        return None
    a, e = set(actual), set(expected)
    return (
        f"rows {len(actual)} vs {len(expected)}; columns {sorted(names)}; "
        f"only spark {sorted(a - e)[:3]}; only oracle {sorted(e - a)[:3]}"
    )
