"""Named queries: each takes ``(spark, sf_dir)`` and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register a function under its own name."""
    QUERIES[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    from mailweave.plans import browsing, ingesting, mail_search, scalars, statistics, threading, upkeep, vector_search  # noqa: F401

    return dict(QUERIES)
