"""Registered queries of this subpackage: key -> ``fn(spark, sf_dir)`` and its DuckDB oracle, if SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Fn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Fn, str | None]] = {}


def query(key: str, sql: str | None = None) -> Callable[[Fn], Fn]:
    def register(fn: Fn) -> Fn:
        QUERIES[key] = (fn, sql)
        return fn

    return register


def load_all() -> dict[str, tuple[Fn, str | None]]:
    importlib.import_module("leafmill.llm.queries")
    return QUERIES
