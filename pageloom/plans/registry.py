"""The registered queries and their oracle SQL, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pageloom.plans import page_queries, rendered_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**page_queries.QUERIES, **rendered_queries.QUERIES}
ORACLE: dict[str, str] = {**page_queries.ORACLE, **rendered_queries.ORACLE}
