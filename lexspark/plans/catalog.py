"""All queries of the core library by name, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexspark.plans import fields, legal, packed_and_nested, reports, retrieval

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval evaluation end to end: search, labels, set metrics, macro means."""
    return retrieval.q_retrieval_macro(spark, sf_dir)


def queries() -> dict[str, Query]:
    return packed_and_nested.QUERIES | retrieval.QUERIES | legal.QUERIES | reports.QUERIES | fields.QUERIES


def oracle_sql() -> dict[str, str]:
    return retrieval.SQL | legal.SQL | reports.SQL | fields.SQL
