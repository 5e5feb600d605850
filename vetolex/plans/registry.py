"""Registry of named queries ``(spark, sf_dir) -> DataFrame`` with optional oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | Callable[[], str] | None = None):
    """Register a query; ``sql`` is the equivalent DuckDB statement (``None`` = rows-only check)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql() if callable(sql) else sql
        return fn
    return deco
