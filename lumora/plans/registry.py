"""Where query modules put their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import for_duckdb

FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        FOUND[f.__name__] = (f, for_duckdb(sql) if sql else None)
        return f

    return add
