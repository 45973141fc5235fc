"""Helpers of the operators: shared intermediate tables, checked broadcasts, word patterns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all word rules: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
NOT_SPACE_RUN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only local sessions get one of their own."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/leafmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; for narrow, small frames."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "inner", max_rows: int = 1_000_000) -> DataFrame:
    """Join that broadcasts ``small`` only if a count proves at most ``max_rows`` rows; otherwise both sides shuffle.

    For sides of a few fixed-width columns (about 50 bytes a row): the bound is some 50 MB.
    """
    few = small.limit(max_rows + 1).count() <= max_rows
    return big.join(F.broadcast(small) if few else small, on, how)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row (an expression inside a lambda is computed at each use)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def longs(value: int) -> Column:
    """A 64-bit pattern as a signed literal."""
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")
