"""Registry of the named queries (``queries()``) and their DuckDB oracles
(``oracle_sql()``). Each query is ``fn(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so that its queries register."""
    from ragframe.plans import chat, chunk_queries, section_queries, scalar_queries, search_queries, ingest_queries, profile_queries, stream_queries, source_queries  # noqa: F401
