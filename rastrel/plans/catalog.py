"""The queries of the raster and contour operators, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rastrel.plans import guard_queries, kernel_queries, pixel_queries, ring_queries, scalar_queries, segment_queries, span_queries

_MODULES = (pixel_queries, ring_queries, scalar_queries, segment_queries, span_queries, guard_queries, kernel_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
