"""Registered queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import feature_queries, property_queries, text_queries, verdict_queries

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hazards of all families over all documents, by language and family."""
    return verdict_queries.run_all_counts(spark, sf_dir)


def _entries() -> dict[str, tuple[Query, str | None]]:
    found = {f"fn_{name}": entry for name, entry in (text_queries.all_entries() | feature_queries.all_entries() | property_queries.all_entries()).items()}
    return found | {f"detect_{name}": entry for name, entry in verdict_queries.all_entries().items()}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries().items() if sql}
