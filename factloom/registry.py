"""All queries on the driver's tables that need nothing but the library's core, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import queries_facts, queries_patterns, queries_values  # noqa: F401  they register their queries
from .plans.queries import ORACLE, QUERIES

FLAGSHIP = "guardless_open_orders"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
