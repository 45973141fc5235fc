"""Drift tests, alerts, recommendations and actions over metric logs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.running import cumulative_counts

# Alert thresholds by statistic; high values are bad for the second group.
LOW_IS_BAD = {"confidence_mean": 0.65, "relevance_mean": 0.60, "faithfulness_mean": 0.70}
HIGH_IS_BAD = {"web_search_rate": 0.40, "human_review_rate": 0.20, "latency_ms_p95": 8000.0}
FAITHFULNESS_FLOOR, PRECISION_FLOOR, LATENCY_CEILING = 0.70, 0.55, 8000.0

# Advice by alerting statistic, then by drifted column, in this order.
ADVICE = (
    ("faithfulness_mean", "re-embed with smaller chunks and higher overlap"),
    ("latency_ms_p95", "profile retrieval and reduce the candidates fetched"),
    ("web_search_rate", "ingest more documents on the missing topics"),
    ("confidence_mean", "check recent documents against query patterns"),
    ("drift:latency_ms", "latency drift: check collection size and index"),
    ("drift:confidence", "confidence drift: evaluate failing query groups"),
)


def kolmogorov_p(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample p-value: 2 * sum (-1)^(k-1) exp(-2 k^2 x^2) with the small-sample x."""
    en = F.sqrt(n1 * n2 / (n1 + n2))
    x = (en + 0.12 + 0.11 / en) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x),
    )
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series)))


def ks_drift(
    samples: DataFrame, columns: list[str], alpha: float = 0.05, min_values: int = 5, min_rows: int = 10
) -> DataFrame:
    """Two-sample KS per column between ``part`` = 'current' and 'reference'.

    Both samples are counted per distinct value and accumulated over value bins, so no column is sorted in
    one task.
    """
    long = samples.select("part", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("r"))
    cur = (F.col("part") == "current").cast("int")
    cum = cumulative_counts(long.select("part", "r.*"), ["column"], "v", {"c": cur, "r": 1 - cur})
    gap = F.abs(F.col("cum_c") / F.col("total_c") - F.col("cum_r") / F.col("total_r"))
    d = cum.groupBy("column").agg(
        F.max("total_c").alias("n_current"), F.max("total_r").alias("n_reference"), F.max(gap).alias("d")
    )
    enough = (F.col("n_current") >= max(min_values, min_rows)) & (F.col("n_reference") >= max(min_values, min_rows))
    p = F.when(enough, kolmogorov_p(F.col("d"), F.col("n_current"), F.col("n_reference")))
    return d.select(
        "column",
        "n_current",
        "n_reference",
        F.when(enough, F.round("d", 6)).alias("drift_score"),
        F.round(p, 4).alias("p_value"),
        F.coalesce(p < alpha, F.lit(False)).alias("drift_detected"),
    )


def quality_alerts(stats: DataFrame, keys: list[str]) -> DataFrame:
    """One row per statistic beyond its threshold, with a message."""
    rows = [
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(x)).alias("threshold"), F.lit(m in HIGH_IS_BAD).alias("high"))
        for m, x in {**LOW_IS_BAD, **HIGH_IS_BAD}.items()
        if m in stats.columns
    ]
    long = stats.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")
    v, x = F.col("value"), F.col("threshold")
    hit = long.where(F.when(F.col("high"), v > x).otherwise(v < x))
    word = F.when(F.col("high"), "exceeds threshold").otherwise("below threshold")
    return hit.withColumn("message", F.concat_ws(" ", F.concat("metric", F.lit(":")), F.format_string("%.3f", v), word, x.cast("string"))).drop("high")


def recommendations(alerts: DataFrame, keys: list[str], drifted: Column | None = None) -> DataFrame:
    """Distinct advice in fixed order. At most one row per statistic and key is gathered."""
    got = alerts.groupBy(*keys).agg(F.collect_set("metric").alias("_m"))
    tags = F.concat("_m", F.transform(drifted, lambda c: F.concat(F.lit("drift:"), c))) if drifted is not None else F.col("_m")
    texts = F.array_compact(F.array(*[F.when(F.array_contains(tags, m), t) for m, t in ADVICE]))
    return got.select(*keys, F.array_distinct(texts).alias("advice"))


def improvement_action(faithfulness: Column, latency_p95: Column, precision: Column, drifted: Column) -> Column:
    return (
        F.when(faithfulness < FAITHFULNESS_FLOOR - 0.15, "rechunk")
        .when(faithfulness < FAITHFULNESS_FLOOR, "re_embed")
        .when((latency_p95 > LATENCY_CEILING) | F.coalesce(precision < PRECISION_FLOOR, F.lit(False)) | drifted, "retune_retrieval")
        .otherwise("alert_only")
    )


def metric_features(events: DataFrame, actions: list[str]) -> DataFrame:
    """Numeric feature row per event; rows without latency or confidence are dropped."""
    return events.where(F.col("latency_ms").isNotNull() & F.col("confidence").isNotNull()).select(
        "event_id",
        "latency_ms",
        "confidence",
        *[F.col(c).cast("double").alias(c) for c in ("answer_length", "retrieval_count", "web_search")],
        *[(F.col("action") == a).cast("double").alias(f"action_{a}") for a in actions],
        F.coalesce("faithfulness", F.lit(math.nan)).alias("faithfulness"),
    )
