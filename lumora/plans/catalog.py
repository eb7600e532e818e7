"""Every query of the timeline, material and search operators with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import admission, executions, intake, ledger, materials, orchestration, timeline
from .registry import FOUND


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in FOUND.items() if sql}


__all__ = ["admission", "executions", "intake", "ledger", "materials", "oracle_sql", "orchestration", "queries", "timeline"]
