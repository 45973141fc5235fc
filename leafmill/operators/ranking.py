"""Ranks, top-k, pages, rate limits, version lists and cool-downs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.operators.running import rank_rows, running, sliding_count


def _positive(k: int, what: str) -> int:
    if int(k) < 1:
        raise ValueError(f"{what} must be at least 1, not {k}")
    return int(k)


def top_k(df: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), tie).limit(_positive(k, "k"))


def page(df: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    if offset < 0:
        raise ValueError(f"offset must not be negative, not {offset}")
    return df.orderBy(*order).offset(offset).limit(_positive(limit, "limit"))


def top_k_per_key(df: DataFrame, keys: list[str], score: str, tie: str, k: int, rank: str = "rank") -> DataFrame:
    """``row_number() <= k`` lets Spark cut each group to k rows before the shuffle (window group limit)."""
    w = W.partitionBy(*keys).orderBy(F.desc(score), F.col(tie))
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def threshold_top_k(df: DataFrame, keys: list[str], score: str, tie: str, k: int, threshold: float) -> DataFrame:
    return top_k_per_key(df.where(F.col(score) >= threshold), keys, score, tie, k)


rank_list = rank_rows

# Requests per window and endpoint group.
RATE_LIMITS = {"query": 100, "ingest": 10, "default": 200, "domains": 50}


def limit_of(group: Column) -> Column:
    out = F.lit(RATE_LIMITS["default"])
    for g, n in RATE_LIMITS.items():
        out = F.when(group == g, n).otherwise(out)
    return out


def sliding_rate_limit(requests: DataFrame, keys: list[str], group: str, window_s: int, tie: str) -> DataFrame:
    """Allow or deny each request by the requests in ``(t - window, t]``, itself and denied ones included."""
    us = requests.withColumn("at_us", F.unix_micros(F.col("ts").cast("timestamp")))
    counted = sliding_count(us, [*keys, group], "at_us", window_s * 1_000_000, tie)
    n, lim = F.col("n_in_window"), limit_of(F.col(group))
    ok = n <= lim
    return counted.select(
        *keys,
        group,
        tie,
        n.alias("n_in_window"),
        ok.alias("allowed"),
        F.greatest(lim - n, F.lit(0)).alias("remaining"),
        (F.col("at_us") + window_s * 1_000_000).alias("reset_at_us"),
        F.when(ok, 0).otherwise(window_s).alias("retry_after"),
    )


def version_history(docs: DataFrame, key: str, version: str, text: str, bin_: Column) -> DataFrame:
    """Version number, newest-first rank and the previous version's text, without gathering a key.

    Only ids are numbered; each text moves twice, as a version's own and as its successor's previous one. Versions are
    unique within their key.
    """
    numbered = running(docs.select(key, version), [key], [F.col(version)], bin_, {"version_no": ("sum", F.lit(1))})
    totals = docs.groupBy(key).agg(F.count("*").alias("n_versions"))
    before = numbered.select(key, (F.col("version_no") + 1).alias("version_no"), F.col(version).alias("_before"))
    told = numbered.join(totals, key).join(before, [key, "version_no"], "left")
    told = told.withColumn("newest_rank", F.col("n_versions") - F.col("version_no") + 1)
    previous_ = docs.select(key, F.col(version).alias("_before"), F.col(text).alias("previous_text"))
    return docs.join(told, [key, version]).join(previous_, [key, "_before"], "left").drop("_before")


def cached_replay(requests: DataFrame, key: str, at: str, cacheable: str, tie: str, ttl_s: int) -> DataFrame:
    """Add ``hit``: does a stored result of the same key answer the request?

    A cacheable request that misses is stored at its time; it answers requests up to ``ttl_s`` seconds later, and a
    hit does not renew it. Whether a request is stored depends on those before it, so a key is folded in order: its
    rows stream through one sorted partition, and the state is one time.
    """
    ttl = ttl_s * 1_000_000
    cols = [tie, key, "_us", cacheable]
    src = requests.select(*[c for c in requests.columns], F.unix_micros(F.col(at).cast("timestamp")).alias("_us"))
    ordered = src.repartition(key).sortWithinPartitions(key, "_us", tie)
    out = [c for c in requests.columns]
    types = dict(requests.dtypes)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, stored = None, None
        for pdf in batches:
            hits = []
            for _, k, us, ok in pdf[cols].itertuples(index=False):
                if k != last_key:
                    last_key, stored = k, None
                hit = stored is not None and us - stored <= ttl
                if not hit and ok:
                    stored = us
                hits.append(hit)
            yield pdf[out].assign(hit=hits)

    return ordered.mapInPandas(fold, ", ".join(f"{c} {types[c]}" for c in out) + ", hit boolean")


def cooldown_gate(alerts: DataFrame, key: str, at: str, hours: float = 24.0) -> DataFrame:
    """At most one action per key per ``hours``.

    Input is one row per key and evaluation run, so a key's rows are bounded by the runs in the period.
    """
    gap = pd.Timedelta(hours=hours)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        fired, last = [], None
        for t in pdf[at].sort_values():
            if last is None or t - last >= gap:
                fired.append(t)
                last = t
        return pd.DataFrame({key: pdf[key].iloc[0], at: fired})

    dtype = dict(alerts.dtypes)
    return alerts.select(key, at).groupBy(key).applyInPandas(fold, f"{key} {dtype[key]}, {at} {dtype[at]}")
