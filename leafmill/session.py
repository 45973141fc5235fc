"""Session defaults. A session the cluster already made is reused as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "leafmill", cores: str | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if cores is not None:  # tests and benchmarks on one machine; a cluster's own settings are never touched
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.driver.memory", "12g")
            .config("spark.sql.shuffle.partitions", cores)
        )
    return builder.getOrCreate()
