"""Running totals, ranks and quantiles that never put a whole group into one task.

A group (a tenant, a column, all rows) is cut into bins along the order. Totals per bin are
small, so a window over them gives what precedes each bin; the row-level window then runs
inside one (group, bin) only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.sources.scratch import written

_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def running(
    df: DataFrame, keys: list[str], order: list, bin_: Column, aggs: dict[str, tuple[str, Column]], peers: bool = False
) -> DataFrame:
    """Add running ``sum``/``min``/``max`` columns over ``order`` per ``keys``.

    ``bin_`` must not decrease along ``order``. With ``peers`` rows that tie on the single
    order column share the value (RANGE frame).
    """
    src = df.withColumn("_bin", bin_).withColumns({f"_in_{n}": c for n, (_, c) in aggs.items()})
    totals = src.groupBy(*keys, "_bin").agg(*[_COMBINE[k][0](f"_in_{n}").alias(f"_tot_{n}") for n, (k, _) in aggs.items()])
    before = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    prior = totals.select(
        *keys, "_bin", *[_COMBINE[k][0](f"_tot_{n}").over(before).alias(f"_prev_{n}") for n, (k, _) in aggs.items()]
    )
    inside = W.partitionBy(*keys, "_bin").orderBy(*order)
    inside = inside.rangeBetween(W.unboundedPreceding, 0) if peers else inside.rowsBetween(W.unboundedPreceding, 0)
    joined = src.join(prior, [*keys, "_bin"])
    out = joined.withColumns(
        {n: _COMBINE[k][1](F.col(f"_prev_{n}"), _COMBINE[k][0](f"_in_{n}").over(inside)) for n, (k, _) in aggs.items()}
    )
    drop = ["_bin", *[f"{p}_{n}" for n in aggs for p in ("_in", "_prev")]]
    return out.drop(*drop)


def previous(df: DataFrame, keys: list[str], order: list[str], bin_: Column, value: str, out: str) -> DataFrame:
    """Value of the row before, per ``keys`` along ``order``, across bins (``value`` must follow the order)."""
    src = df.withColumn("_bin", bin_)
    last = src.groupBy(*keys, "_bin").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    earlier = last.select(*keys, "_bin", F.lag("_last").over(W.partitionBy(*keys).orderBy("_bin")).alias("_prev"))
    inside = F.lag(value).over(W.partitionBy(*keys, "_bin").orderBy(*order))
    return src.join(earlier, [*keys, "_bin"]).withColumn(out, F.coalesce(inside, "_prev")).drop("_bin", "_prev")


def cumulative_counts(df: DataFrame, keys: list[str], value: str, counts: dict[str, Column] | None = None) -> DataFrame:
    """Distinct values per group with running counts (``cum_*``) and group totals (``total_*``).

    Distinct values are counted before they move and then dealt by range of (keys, value), with the borders that Spark
    samples: a group of any size, or one that holds all rows, is spread over as many tasks as the session shuffles to,
    and the task's number is the bin of its values. Counts are written once, as the borders would differ in a second run.
    """
    counts = counts or {"n": F.lit(1)}
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if not keys:
        clean, keys_ = clean.withColumn("_all", F.lit(0)), ["_all"]
    else:
        keys_ = keys
    dist = clean.groupBy(*keys_, value).agg(*[F.sum(c).alias(n) for n, c in counts.items()])
    dealt = written(dist.repartitionByRange(*keys_, value).withColumn("_range", F.spark_partition_id()), "counts")
    cum = running(dealt, keys_, [F.col(value)], F.col("_range"), {f"cum_{n}": ("sum", F.col(n)) for n in counts}).drop("_range")
    totals = dealt.groupBy(*keys_).agg(*[F.sum(n).alias(f"total_{n}") for n in counts])
    out = cum.join(totals, keys_)
    return out if keys else out.drop("_all")


def percentiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], method: str = "linear", min_n: int = 2
) -> DataFrame:
    """Exact percentiles per group.

    ``linear`` interpolates between neighbours and is NULL below ``min_n`` values; ``nearest`` takes
    ``sorted[min(int(n * p), n - 1)]``.
    """
    ranked = cumulative_counts(df, keys, value)
    n, end, start = F.col("total_n"), F.col("cum_n"), F.col("cum_n") - F.col("n")

    def at(rank: Column) -> Column:
        return F.max(F.when((start <= rank) & (rank < end), F.col(value)))

    aggs = [F.max(n).alias("n_values")]
    for name, p in probs.items():
        if method == "nearest":
            aggs.append(at(F.least(F.floor(n * F.lit(round(p * 100, 6)) / 100), n - 1)).alias(name))
        else:
            pos = (n - 1) * F.lit(p)
            aggs += [
                at(F.floor(pos)).alias(f"_lo_{name}"),
                at(F.ceil(pos)).alias(f"_hi_{name}"),
                F.max(pos - F.floor(pos)).alias(f"_fr_{name}"),
            ]
    out = ranked.groupBy(*keys).agg(*aggs)
    if method == "linear":
        for name in probs:
            lo, hi, fr = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_fr_{name}")
            out = out.withColumn(name, F.when(F.col("n_values") >= min_n, lo + (hi - lo) * fr)).drop(
                f"_lo_{name}", f"_hi_{name}", f"_fr_{name}"
            )
    return out


def sliding_count(df: DataFrame, keys: list[str], micros: str, window_us: int, tie: str) -> DataFrame:
    """Rows of the same key in ``(t - window, t]`` for every row (ties at ``t`` included).

    Each row enters at ``t`` and leaves at ``t + window``; the count is the running sum of both.
    """
    enter = df.select(*keys, F.col(tie), F.col(micros).alias("_at"), F.lit(1).alias("_w"))
    leave = df.select(
        *keys, F.lit(None).cast(dict(df.dtypes)[tie]).alias(tie), (F.col(micros) + window_us).alias("_at"), F.lit(-1).alias("_w")
    )
    run = running(
        enter.unionByName(leave),
        keys,
        [F.col("_at")],
        F.floor(F.col("_at") / max(window_us // 64, 1)),
        {"n_in_window": ("sum", F.col("_w"))},
        peers=True,
    )
    return run.where(F.col(tie).isNotNull()).select(*keys, tie, F.col("_at").alias(micros), "n_in_window")


def rank_rows(df: DataFrame, keys: list[str], score: str, tie: str, out: str = "rank", tie_grain: int = 65_536) -> DataFrame:
    """1-based rank by score descending, then by the integer ``tie``.

    Rows above come from counts of distinct scores; the place among equal scores from bins of ``tie``.
    So neither a large group nor one score that a third of the rows share ends in one task.
    """
    above = cumulative_counts(df, keys, score).select(*keys, score, (F.col("total_n") - F.col("cum_n")).alias("_above"))
    within = running(
        df, [*keys, score], [F.col(tie)], F.floor(F.col(tie) / tie_grain), {out: ("sum", F.lit(1))}
    )
    return (
        within.join(above, [*keys, score])
        .withColumn(out, (F.col(out) + F.col("_above")).cast("int"))
        .drop("_above")
    )
