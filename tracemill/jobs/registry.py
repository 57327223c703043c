"""All queries of the library's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracemill.jobs import memory_queries, plan_queries, stream_queries, tool_queries

_PARTS = (memory_queries, stream_queries, tool_queries, plan_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for part in _PARTS for k, s in part.ORACLE_SQL.items()}
