"""Registry of named queries: a DataFrame builder and, where SQL can say the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under ``name``."""
    def add(builder: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = builder
        if sql is not None:
            SQL[name] = sql
        return builder

    return add


def load() -> None:
    """Import every module that registers queries."""
    from quarry.plans import (  # noqa: F401
        access, chunks, evaluation, models, operations, retrieval, sources, streams, text)
