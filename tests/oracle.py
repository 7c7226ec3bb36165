"""Runs a query and its DuckDB text on the same tables and compares rows without regard to order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = Path(d, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if p.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def _value(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9) + 0.0)
    if isinstance(x, int):
        return repr(float(x)) if abs(x) < 1 << 53 else x
    if isinstance(x, list | tuple):
        return [_value(y) for y in x]
    return str(x)


def rows(columns: list[str], values) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([_value(v[i]) for i in order]) for v in values)


def difference(spark, c, query, sql: str, d: str) -> str:
    """Empty if both give the same rows under the same column names."""
    df = query(spark, d)
    rel = c.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    a, b = rows(df.columns, df.collect()), rows(rel.columns, rel.fetchall())
    if a == b:
        return ""
    only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} and {len(b)} rows; only in Spark: {only_a}; only in DuckDB: {only_b}"
