"""All registered queries of the source-change operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import graph_queries, report_queries, review_queries, session_queries, source_queries

MODULES = (review_queries, graph_queries, session_queries, source_queries, report_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
