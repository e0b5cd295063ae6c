"""Run a registered query in Spark and its oracle SQL in DuckDB; compare like the driver:
row count, column names, order-insensitive values."""

from __future__ import annotations

import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

# DuckDB result types and the Spark types they correspond to
DUCK_TYPES = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "INTEGER": "int",
              "BOOLEAN": "boolean"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return ("nan",)
    if hasattr(v, "item"):
        v = v.item()
    return v


def _key(row):
    return tuple((v is None, str(type(v).__name__) if v is not None else "", v if v is not None else 0)
                 for v in row)


def compare(spark_df, con, sql: str) -> list[str]:
    """Empty list when equal; else the differences found."""
    sp_cols = spark_df.columns
    sp_rows = [tuple(_norm(v) for v in r) for r in spark_df.collect()]
    rel = con.sql(sql)
    dk_cols = rel.columns
    dk_rows = [tuple(_norm(v) for v in r) for r in rel.fetchall()]
    problems: list[str] = []
    if sorted(sp_cols) != sorted(dk_cols):
        return [f"columns differ: spark={sp_cols} oracle={dk_cols}"]
    sp_types = dict(spark_df.dtypes)
    dk_types = {c: DUCK_TYPES.get(str(t), str(t)) for c, t in zip(dk_cols, rel.types)}
    if sp_types != dk_types:
        problems.append(f"types differ: spark={sp_types} oracle={dk_types}")
    order = [dk_cols.index(c) for c in sp_cols]
    dk_rows = [tuple(r[i] for i in order) for r in dk_rows]
    if len(sp_rows) != len(dk_rows):
        problems.append(f"row count: spark={len(sp_rows)} oracle={len(dk_rows)}")
    a, b = sorted(sp_rows, key=_key), sorted(dk_rows, key=_key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        problems.append(f"{len(bad)} differing rows, e.g. spark={bad[0][0]} oracle={bad[0][1]}")
    return problems
