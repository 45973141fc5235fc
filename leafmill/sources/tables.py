"""Parquet table set with declared schemas (no inference on read)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

SCHEMAS: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


# Text tables: per-row work is heavy enough that every core should get a share.
SPREAD_BY = {"documents": "doc_id", "pages": "page_id"}


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a scan that has fewer splits than there are cores (one small file); larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


class Tables:
    """Lazy access to the tables of one data directory: ``Tables(spark, d).documents``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        df = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}.parquet")
        return spread(df, SPREAD_BY[name]) if name in SPREAD_BY else df

    @cached_property
    def all(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in SCHEMAS}


def load_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return Tables(spark, path).all
