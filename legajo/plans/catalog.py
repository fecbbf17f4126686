"""Registry of the queries the engine ships, each with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}
ROWS: dict[str, str] = {}

MODULES = [
    "consolidation_queries",
    "classification_queries",
    "extraction_queries",
    "registry_queries",
    "case_queries",
    "ocr_queries",
    "finding_queries",
    "feedback_queries",
    "usage_queries",
    "progress_queries",
    "report_queries",
    "stream_queries",
    "store_queries",
    "lookup_queries",
]


def register(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, the operator rows it covers and its SQL."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        ROWS[name] = covers
        if sql:
            TWINS[name] = sql
        return function

    return add


def load() -> None:
    for module in MODULES:
        import_module(f"legajo.plans.{module}")
