"""Vector columns over array<double>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 1e-12, dot(a, b) / n).otherwise(0.0)


def mean_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Element-wise mean per key: averages combine on the map side, only ``dim`` rows per key are gathered."""
    parts = df.select(*keys, F.posexplode(vector).alias("_i", "_x"))
    means = parts.groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"])
    return means.groupBy(*keys).agg(ordered.alias(vector))


def hash_features(df: DataFrame, key: str, tokens: Column, dim: int = 64) -> DataFrame:
    """Signed feature hashing as (key, idx, value) rows with unit norm per key.

    The first four sha-256 bytes, little end first, pick the slot; the fifth byte's parity is the sign.
    """
    h = F.sha2(F.col("_tok"), 256)
    slot = F.conv(F.concat(*[F.substring(h, p, 2) for p in (7, 5, 3, 1)]), 16, 10).cast("bigint") % dim
    sign = F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    hashed = df.select(key, F.explode(tokens).alias("_tok")).select(key, slot.cast("int").alias("idx"), sign.alias("_s"))
    sums = hashed.groupBy(key, "idx").agg(F.sum("_s").alias("_s")).where("_s <> 0")
    norms = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("_s") * F.col("_s"))).alias("_n"))
    return sums.join(norms, key).select(key, "idx", (F.col("_s") / F.col("_n")).alias("value"))


def hash_embed(df: DataFrame, key: str, tokens: Column, dim: int = 64) -> DataFrame:
    """(key, embedding array<double>) from signed feature hashing; at most ``dim`` values are gathered per key."""
    h = F.sha2(F.col("_tok"), 256)
    slot = F.conv(F.concat(*[F.substring(h, p, 2) for p in (7, 5, 3, 1)]), 16, 10).cast("bigint") % dim
    sign = F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    hashed = df.select(key, F.explode(tokens).alias("_tok")).select(key, slot.cast("int").alias("idx"), sign.alias("_s"))
    sums = hashed.groupBy(key, "idx").agg(F.sum("_s").alias("_s"))
    sparse = sums.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("idx", "_s"))).alias("_m"),
        F.sqrt(F.sum(F.col("_s") * F.col("_s"))).alias("_n"),
    )
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0)) / F.when(F.col("_n") > 0, F.col("_n")).otherwise(1.0),
    )
    return sparse.select(key, dense.alias("embedding"))
