"""Registered queries of the library and their SQL; the modules of this folder fill it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MODULES = [
    "text_queries", "dedupe_queries", "retrieval_queries", "evaluation_queries", "practice_queries", "governance_queries", "structure_queries",
    "streaming_queries",
]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query ``(spark, sf_dir) -> DataFrame`` under its name, with equivalent SQL if there is any."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _load() -> None:
    for m in MODULES:
        import_module(f"corpusloom.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to chunks, exact dedupe, BM25 for the benchmark texts, ranking metrics."""
    return queries()["flagship_slice"](spark, sf_dir)
