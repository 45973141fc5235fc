"""Aggregates over logs, chunks and keyed value tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.running import percentiles


def clean(c: Column) -> Column:
    """NaN as NULL, so built-in aggregates skip it."""
    return F.when(~F.isnan(c.cast("double")), c)


def round_scaled(c: Column, digits: int) -> Column:
    """Round half away from zero after scaling in doubles, as SQL engines do: 1759.9499999999998 has 1760.0 at one digit."""
    return F.round(c * float(10**digits)) / float(10**digits)


def tidy(c: Column, digits: int) -> Column:
    """Round after clearing floating-point noise, so a tie rounds the same way whatever the sum order."""
    return round_scaled(F.round(c, 9), digits)


def window_stats(metrics: DataFrame, now: Column, hours: float, key: str = "workspace_id") -> DataFrame:
    """One row per tenant over ``(now - hours, now]``: means, percentiles, rates, action mix, alerts."""
    if hours <= 0:
        raise ValueError(f"hours must be positive, not {hours}")
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600).cast("decimal(18,6)"))
    recent = metrics.where((F.col("ts") > now - span) & (F.col("ts") <= now))
    means = {"latency_ms": 1, "confidence": 4, "relevance": 4, "answer_length": 1, "retrieval_count": 2, "faithfulness": 4}
    base = recent.groupBy(key).agg(
        F.count("*").alias("query_count"),
        *[tidy(F.avg(clean(F.col(c))), d).alias(f"{c}_mean") for c, d in means.items()],
        F.avg(clean(F.col("faithfulness"))).alias("_f"),
        tidy(F.avg(F.col("web_search").cast("double")), 4).alias("web_search_rate"),
        tidy(F.avg(F.col("human_review").cast("double")), 4).alias("human_review_rate"),
    )
    pct = percentiles(recent, [key], "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).select(
        key, *[tidy(F.coalesce(p, F.lit(0.0)), 1).alias(f"latency_ms_{p}") for p in ("p50", "p95", "p99")],
        (F.coalesce("p95", F.lit(0.0)) > 8000).alias("latency_alert"),
    )
    mix = (
        recent.groupBy(key, "action").count().groupBy(key)
        .agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "action", "count"))), ",").alias("action_mix"))
    )
    return (
        base.join(pct, key).join(mix, key)
        .withColumn("faithfulness_alert", F.coalesce(F.col("_f") < 0.70, F.lit(False)))
        .withColumn("window_hours", F.lit(float(hours)))
        .drop("_f")
    )


def exact_duplicates(chunks: DataFrame, file: str, text: str) -> DataFrame:
    """Files with the same set of chunk texts: (file, fingerprint, n_files, first_file).

    The fingerprint folds distinct chunk hashes with order-free sums, so a file's hashes are never
    gathered, and members meet their group by a join, so a large group is not gathered either.
    """
    h = chunks.select(file, F.md5(F.col(text)).alias("h")).distinct()

    def part(pos: int) -> Column:
        return F.conv(F.substring("h", pos, 8), 16, 10).cast("bigint")

    fp = h.groupBy(file).agg(
        F.concat_ws(
            "-", F.count("*"), *[F.sum(part(p)).cast("string") for p in (1, 9, 17, 25)], F.bit_xor(part(1)), F.bit_xor(part(17))
        ).alias("fingerprint")
    )
    groups = fp.groupBy("fingerprint").agg(F.count("*").alias("n_files"), F.min(file).alias("first_file")).where("n_files > 1")
    return fp.join(groups, "fingerprint")


def discrepancies(a: DataFrame, b: DataFrame, keys: list[str], high: list[str]) -> DataFrame:
    """Field-by-field comparison of two (keys..., field, value) tables."""
    j = a.withColumnRenamed("value", "value_a").join(b.withColumnRenamed("value", "value_b"), [*keys, "field"], "full")
    same = F.col("value_a").eqNullSafe(F.col("value_b"))
    return j.where(~same).select(
        *keys,
        "field",
        F.coalesce("value_a", F.lit("Not found")).alias("value_a"),
        F.coalesce("value_b", F.lit("Not found")).alias("value_b"),
        F.when(F.col("field").isin(*high), "high").otherwise("medium").alias("severity"),
    )


def year_over_year(cur: DataFrame, prev: DataFrame, key: str) -> DataFrame:
    """Changes in per cent, with the sign of what rounds to zero (-0.00%) and of what has no base (inf%)."""
    j = cur.withColumnRenamed("value", "current").join(prev.withColumnRenamed("value", "previous"), key, "full")
    raw = F.try_divide(F.col("current") - F.col("previous"), F.col("previous")) * 100
    change = round_scaled(raw, 2)
    return j.select(
        key,
        "current",
        "previous",
        F.when(F.col("previous").isNull(), "New")
        .when(F.col("current").isNull(), "Removed")
        .when(F.col("current") == F.col("previous"), "Same")
        .when(F.col("previous") == 0, F.when(F.col("current") > 0, "inf%").otherwise("-inf%"))
        .when((raw < 0) & (change == 0), "-0.00%")
        .otherwise(F.format_string("%.2f%%", change))
        .alias("change"),
    )


def first_per_name(rows: DataFrame, owner: str, name: str, order: list[str]) -> DataFrame:
    """First occurrence of each case-folded name per owner, chosen by a map-side combinable minimum."""
    rest = [c for c in rows.columns if c not in (owner, name, *order)]
    folded = rows.withColumn("_fold", F.lower(F.trim(F.col(name)))).where("_fold <> ''")
    pick = F.min(F.struct(*order, name, *rest)).alias("r")
    return folded.groupBy(owner, "_fold").agg(pick).select(owner, F.col("_fold").alias("folded"), "r.*")
