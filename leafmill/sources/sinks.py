"""Sinks: CSV reports, datasets, dead letters, gauge lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def report_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fixed column order, every value as text, missing ones empty."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def csv_report(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV folder of :func:`report_columns`, one header per part file."""
    report_columns(df, columns).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Evaluation or triplet rows, one folder per (domain, version)."""
    df.write.mode("append").partitionBy("domain", "version").format(fmt).save(path)


def dataset_registry(rows: DataFrame, recency: str, size: str) -> DataFrame:
    """One row per (domain, version), newest first. The window sees one row per dataset, not per sample."""
    grouped = rows.groupBy("domain", "version").agg(
        F.count("*").alias("n_samples"), F.sum(size).alias(size), F.max(recency).alias("last_id")
    )
    order = W.orderBy(F.desc("last_id"), "domain", "version")
    return grouped.withColumn("newest_rank", F.row_number().over(order))


def dead_letter(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad rows keep the names of the checks that failed."""
    failed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    marked = df.withColumn("reasons", failed)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def recent_dead_letters(bad: DataFrame, at: str, file: Column | None = None, limit: int = 100) -> DataFrame:
    return (bad.where(file) if file is not None else bad).orderBy(F.desc(at)).limit(limit)


def prometheus_gauges(stats: DataFrame, actions: DataFrame, prefix: str) -> DataFrame:
    """(metric, type, value) rows from one wide stats row and a (action, count) table."""
    wide = stats.unpivot([], stats.columns, "name", "value")
    lines = wide.select(
        F.concat(F.lit(prefix + "_"), "name").alias("metric"),
        F.when(F.col("name").endswith("_total"), "counter").otherwise("gauge").alias("type"),
        "value",
    )
    per_action = actions.select(
        F.concat(F.lit(prefix + "_action_"), F.regexp_replace("action", r'[- "]', "_")).alias("metric"),
        F.lit("counter").alias("type"),
        F.col("count").cast("double").alias("value"),
    )
    return lines.unionByName(per_action)
