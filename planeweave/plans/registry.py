"""Registered queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from planeweave.plans.oracle import statement

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under `name`, with its check SQL when there is one."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = statement(sql)
        return fn
    return add
