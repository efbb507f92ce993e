"""Named queries over the test tables, each with an equivalent SQL text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagecorpus.plans.views import Views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
# The module that registered a query.
MODULES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[Views], DataFrame]], Callable[[Views], DataFrame]]:
    """Register a function of the views under its own name."""

    def register(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        MODULES[build.__name__] = build.__module__
        QUERIES[build.__name__] = lambda spark, folder: build(Views(spark, folder))
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


def load() -> None:
    """Import the modules that register queries."""
    from pagecorpus.plans import queries_layout, queries_pages, queries_text, queries_translation  # noqa: F401
