"""Exact deduplication against a persistent digest index, bucketed and sorted by digest.

A batch is reduced to one row per digest (combined before the shuffle) and anti-joined by sort-merge with the runs of the
index; what is new becomes a run of its own. A run is a table with one sorted file for each bucket, so the join neither
shuffles nor sorts it. Two runs of equally many batches are merged bucket by bucket, again without a shuffle, so that n
batches leave at most log2(n) + 1 runs and every row is rewritten at most log2(n) times.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.shared import checkpointed

#: White space that changes under normalisation: anything but a lone blank.
_ODD_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one blank; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _ODD_SPACE, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, row, digest)``; ``row`` tells rows of one id apart (keep the frame, don't compute it twice)."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"),
    )


def _first(digests_: DataFrame) -> DataFrame:
    """One row per digest: the row of the smallest id (null ids last)."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    return digests_.groupBy("digest").agg(F.min(order).alias("f")).select(
        "digest", F.col("f.doc_id").alias("keep_id"), F.col("f.row").alias("keep_row")
    )


#: Makes Spark trust the order of a bucketed scan with one file for each bucket.
_TRUST_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_TRUST_ORDER, None)
    spark.conf.set(_TRUST_ORDER, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_TRUST_ORDER)
        else:
            spark.conf.set(_TRUST_ORDER, before)


class DigestIndex:
    """Tables ``<name>_r<first>_<last>_<id>`` of ``(digest, keep_id, keep_row)``, one for each run of batches.

    A table exists only when it is complete, and a run counts only while no other covers its batches; so a job that dies
    while it appends or merges leaves nothing that a reader sees twice. One writer at a time. ``buckets`` is fixed when
    the first run is made: about one for each 256 MB that the index shall reach.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64):
        self.spark, self.name, self.buckets = spark, name, buckets
        runs = self.runs()
        if runs:
            detail = spark.sql(f"describe extended {runs[0][2]}").where("col_name = 'Num Buckets'").first()
            self.buckets = int(detail["data_type"])

    def _tables(self) -> list[tuple[int, int, str]]:
        database, _, base = self.name.lower().rpartition(".")
        found = []
        for t in self.spark.catalog.listTables(database or None, f"{base}_r*"):
            parts = t.name.lower().removeprefix(f"{base}_r").split("_")
            if not t.isTemporary and len(parts) == 3 and parts[0].isdigit() and parts[1].isdigit():
                found.append((int(parts[0]), int(parts[1]), f"{database}.{t.name}" if database else t.name))
        return sorted(found, key=lambda r: (r[0], -r[1], r[2]))

    def runs(self) -> list[tuple[int, int, str]]:
        """``(first batch, last batch, table)`` in order; runs that a longer one covers are left out."""
        out: list[tuple[int, int, str]] = []
        for run in self._tables():
            if not out or run[1] > out[-1][1]:
                out.append(run)
        return out

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        name = f"{self.name}_r{first}_{last}_{uuid.uuid4().hex[:12]}"
        rows.write.bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name)

    def unseen(self, rows: DataFrame) -> DataFrame:
        """``rows(digest, ...)`` whose digest no run holds. Only ``rows`` is shuffled and sorted, once."""
        rows = rows.repartition(self.buckets, "digest")
        for _, _, name in self.runs():
            rows = rows.join(self.spark.table(name).select("digest").hint("merge"), "digest", "left_anti")
        return rows

    def append(self, batch: DataFrame) -> None:
        """Add the digests of ``batch(doc_id, row, digest)`` that the index does not hold yet.

        Within a batch the smallest id stays; across batches the earlier batch does. A batch that is appended again
        (after a failure, say) adds nothing.
        """
        new = checkpointed(_first(batch))
        runs = self.runs()
        at = runs[-1][1] + 1 if runs else 0
        with _sorted_scans(self.spark):
            self._write(self.unseen(new), at, at)
            self._merge()

    def _merge(self) -> None:
        runs = self.runs()
        while len(runs) > 1 and runs[-2][1] - runs[-2][0] == runs[-1][1] - runs[-1][0]:
            self._write(self.merged(runs[-2][2], runs[-1][2]), runs[-2][0], runs[-1][1])
            runs = self.runs()
        live = {name for _, _, name in runs}
        for _, _, name in self._tables():
            if name not in live:
                self.spark.sql(f"drop table {name}")

    def merged(self, one: str, two: str) -> DataFrame:
        """The rows of two runs, which share no digest: a full sort-merge join of bucket beside bucket moves no row."""
        left, right = self.spark.table(one).alias("one"), self.spark.table(two).hint("merge").alias("two")
        both = left.join(right, "digest", "full")  # each digest stands on one side, so at most one of two values is there
        return both.select("digest", *[F.coalesce(f"one.{c}", f"two.{c}").alias(c) for c in ("keep_id", "keep_row")])

    def rows(self) -> DataFrame:
        """The index without its bucketing: joins with data of skewed digests are then free to split partitions."""
        runs = [self.spark.table(name).select("digest", "keep_id", "keep_row") for _, _, name in self.runs()]
        if not runs:
            raise ValueError(f"the index {self.name} holds no batch yet")
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out

    def drop(self) -> None:
        for _, _, name in self._tables():
            self.spark.sql(f"drop table {name}")


def deduplicated(batches: list[DataFrame], index: DigestIndex) -> DataFrame:
    """Append each batch of ``(doc_id, row, digest)`` in turn; every row with the row that stays and its group.

    Returns ``(doc_id, keep_id, group_size, kept, digest)``; group sizes count the rows of these batches. Of repeated
    rows (same id, same text) one is kept. Null and empty texts are one group; an empty table gives no rows.
    """
    every = batches[0]
    for b in batches[1:]:
        every = every.unionByName(b)
    for b in batches:
        index.append(b)
    sizes = every.groupBy("digest").agg(F.count("*").alias("group_size"))
    groups = sizes.join(index.rows(), "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row"))
    return every.join(groups, "digest").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")
