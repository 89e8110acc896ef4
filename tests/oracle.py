"""Compare a query with its DuckDB SQL: row count, column names and an order-insensitive set of values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if they agree."""
    got = df.toArrow()
    want = con.execute(sql).to_arrow_table()
    columns = sorted(got.column_names)
    if columns != sorted(want.column_names):
        return f"columns {columns} and {sorted(want.column_names)}"
    kinds = [(c, got.schema.field(c).type, want.schema.field(c).type) for c in columns if str(got.schema.field(c).type) != str(want.schema.field(c).type)]
    kinds = [k for k in kinds if not {str(k[1]), str(k[2])} <= {"string", "large_string"}]
    rows = [sorted(zip(*([norm(v) for v in t.column(c).to_pylist()] for c in columns), strict=True), key=repr) for t in (got, want)]
    if len(rows[0]) != len(rows[1]):
        return f"{len(rows[0])} and {len(rows[1])} rows"
    bad = [(a, b) for a, b in zip(*rows, strict=True) if a != b]
    said = f"{len(bad)} of {len(rows[0])} rows differ, as {columns}: {bad[0]}" if bad else ""
    return said + (f" types {kinds}" if kinds else "")
