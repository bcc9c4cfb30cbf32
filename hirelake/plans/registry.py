"""Registry of the named queries: each is a Spark plan over the given tables
(``fn(spark, sf_dir) -> DataFrame``) and, where SQL can say the same thing,
its DuckDB twin used as the correctness oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}
INVENTORY: dict[str, list[str]] = {}


def query(name: str, sql: str | None = None, ids: tuple[str, ...] = ()):
    """Register ``fn`` under ``name`` with optional oracle SQL and the
    inventory ids (SURVEY §2) it covers."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        INVENTORY[name] = list(ids)
        return fn
    return deco


def load_all() -> None:
    # importing the plan modules fills the registry
    from hirelake.plans import (  # noqa: F401
        q_postings, q_discovery, q_dedupe, q_sequences, q_documents, q_search, q_streams, q_stored,
    )
