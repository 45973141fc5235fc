"""Files of a folder by their first bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as X

#: More than the longest signature, since a file must go on after it.
HEAD_BYTES = 16


def scan_folder(spark: SparkSession, folder: str, pattern: str = "*", deep: bool = True) -> DataFrame:
    """``(path, name, length, modified, format, confidence)`` of each file under ``folder`` whose name fits ``pattern``.

    A file is cut to its head where it is read, so contents are never shuffled. Signatures decide first, then the
    extension; names with other than letters, digits, dots, dashes and underscores are of unknown format, and so are
    files that have neither. Empty files have no row: the source does not list them.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(deep).lower())
    files = reader.load(folder).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"),
        F.hex(F.substring("content", 1, HEAD_BYTES)).alias("head"),
    )
    found = files.withColumn("f", X.file_format(F.col("head"), F.url_decode("name")))
    return found.select("path", F.url_decode("name").alias("name"), "length", "modified", "f.format", "f.confidence")
