"""From raw documents to packed training windows, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``docs``. Rows that repeat a document (same id, same text)
count as one document from the near-duplicate stage on; different texts under one id, or without an id, are different
documents in the first three stages. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import lines, mixing, packing, quality, simhash
from leafmill.llm.queries import quality_weights, tokenizer_path
from leafmill.llm.shared import join_checked, stored, table


def _identity(*cols: str) -> list[Column]:
    """``k1, k2``: 128 bits of the columns' values; a null differs from every value."""
    values = [x for c in cols for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(k), *values).alias(f"k{k}") for k in (1, 2)]


def _free(docs: DataFrame, name: str) -> str:
    """``name``, with underscores behind where ``docs`` has such a column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _keyed(docs: DataFrame, key: Column) -> tuple[DataFrame, str]:
    """``docs`` with a row key and its name: ids may be null or stand over several texts, so no stage decides by id alone."""
    name = _free(docs, "_row")
    return docs.select("*", key.alias(name)), name


def _only(keyed: DataFrame, name: str, keys: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose row key is among ``keys(doc_id)``."""
    one, two = _free(keyed, "_k1"), _free(keyed, "_k2")
    keys = keys.select(F.col("doc_id.k1").alias(one), F.col("doc_id.k2").alias(two))
    same = (F.col(f"{name}.k1") == F.col(one)) & (F.col(f"{name}.k2") == F.col(two))
    return join_checked(keyed, keys, same, "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules keep."""
    keyed, row = _keyed(docs, F.struct(*_identity("doc_id", "text", "lang", "source")))
    return _only(keyed, row, quality.judged(keyed, row).where("kept")).drop(row)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those of which nothing is left are dropped. ``n_chars`` is counted anew."""
    keyed, row = _keyed(docs, F.struct("doc_id", *_identity("doc_id", "text")))
    clean = lines.without_repeats(keyed, lines.line_groups(keyed, row), row)
    clean = clean.where(F.length(F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))) > 0)
    kind = docs.schema["n_chars"].dataType
    return clean.select(*[F.length("text").cast(kind).alias(c) if c == "n_chars" else c for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest id (a null id is largest), then text hash."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *_identity("doc_id", "text"))
    keyed, row = _keyed(docs, key)
    near = stored(simhash.near_duplicates(keyed, row).select("doc_id", "component_id"))
    kept = _only(keyed, row, near.where(F.col("doc_id").eqNullSafe(F.col("component_id"))))
    repeated = near.groupBy("doc_id.k1", "doc_id.k2").agg(F.count("*").alias("n")).where("n > 1")
    return (kept if repeated.isEmpty() else kept.dropDuplicates([row])).drop(row)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mixture(docs, quality_weights(table(spark, sf_dir, "labels")))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 4096-token sequences, with their token ids."""
    pieces = packing.pack(docs, tokenizer_path())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids"
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("packing", pack_windows),
]

#: SimHash and the tokenizer are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
