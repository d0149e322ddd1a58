"""The registry of queries: each with the Spark plan and the checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelens.plans.oracle_base import with_ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Decorator: file a query under ``key`` with its checking SQL."""
    def keep(query: Query) -> Query:
        QUERIES[key] = query
        if sql is not None:
            ORACLES[key] = with_ctes(sql, extra)
        return query

    return keep


def load() -> None:
    from sitelens.plans import (  # noqa: F401
        catalog_analysis,
        catalog_crawl,
        catalog_packs,
        catalog_results,
        catalog_scalars,
        catalog_sources,
        catalog_streams,
    )
