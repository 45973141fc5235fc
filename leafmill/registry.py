"""Registered queries: key -> (callable over a table set, DuckDB oracle)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from leafmill.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    key: str
    survey_id: str
    fn: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.fn(Tables(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def query(key: str, survey_id: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``key``; ``sql`` must return the same rows."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key!r}")
        QUERIES[key] = Query(key, survey_id, fn, sql)
        return fn

    return register


def load_all() -> dict[str, Query]:
    from leafmill import plans

    plans.load()
    return QUERIES
