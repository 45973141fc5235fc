"""Upserts, deletes, plan changes and new vectors as whole-table rewrites (no lakehouse format is assumed)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources.scratch import stored_at


def upsert(base: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Last write per key wins; a grouped ``max_by`` combines on the map side, so hot keys stay cheap."""
    rest = [c for c in base.columns if c != key]
    both = base.unionByName(changes.select(*base.columns))
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("r")).select(key, "r.*")


def new_rows(candidates: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return candidates.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def delete_cascade(tables: dict[str, DataFrame], victims: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(remaining tables, removed counts per table)."""
    kill = victims.select(key).distinct()
    kept = {n: df.join(kill, key, "left_anti") for n, df in tables.items()}
    removed = None
    for n, df in tables.items():
        c = df.join(kill, key, "left_semi").agg(F.count("*").alias("n_removed")).select(F.lit(n).alias("table_name"), "n_removed")
        removed = c if removed is None else removed.unionByName(c)
    return kept, removed


# Plan limits (NULL = unlimited).
PLANS = (
    ("free", 5, 50, 0.1),
    ("starter", 100, 500, 2.0),
    ("pro", 1000, None, 20.0),
    ("enterprise", None, None, None),
)
PLAN_SCHEMA = "plan string, max_docs int, max_queries int, max_storage_gb double"


def plan_column(plan: Column, index: int, dtype: str) -> Column:
    """Limit of a plan as a literal CASE: the plan table is four fixed rows."""
    out = F.lit(None).cast(dtype)
    for row in PLANS:
        out = F.when(plan == row[0], F.lit(row[index]).cast(dtype)).otherwise(out)
    return out


def apply_plan(workspaces: DataFrame, changes: DataFrame) -> DataFrame:
    """Set plan and status and copy the plan's limits; an unknown plan leaves the limits alone."""
    known = F.col("new_plan").isin(*[p[0] for p in PLANS])
    j = workspaces.join(changes, "workspace_id", "left")
    limits = {
        c: F.when(known, plan_column(F.col("new_plan"), i, t)).otherwise(F.col(c))
        for i, (c, t) in enumerate([("max_docs", "int"), ("max_queries", "int"), ("max_storage_gb", "double")], 1)
    }
    return (
        j.withColumns(limits)
        .withColumns({"plan": F.coalesce("new_plan", "plan"), "status": F.coalesce("new_status", "status")})
        .drop("new_plan", "new_status")
    )


Embed = Callable[[DataFrame], DataFrame]


class VectorStore:
    """Versions of the vectors of a collection under one folder; readers see the version that the manifest names.

    ``vectors/version=V/part=P`` and ``failed/version=V/part=P`` are written part by part, a ``parts`` row commits each, and
    a ``manifest`` row, last of all, makes the version the current one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _rows(self, table: str, schema: str) -> DataFrame:
        path = f"{self.path}/{table}"
        return self.spark.read.schema(schema).parquet(path) if stored_at(self.spark, path) else self.spark.createDataFrame([], schema)

    def _add(self, table: str, row: tuple, schema: str) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{table}")

    def current(self) -> str | None:
        """The version that was finished last."""
        last = self._rows("manifest", "version string, number int").orderBy(F.desc("number")).first()
        return last.version if last else None

    def vectors(self, version: str | None = None) -> DataFrame:
        """``(key, embedding)`` of a version, the current one by default; none before there is one."""
        version = version or self.current()
        rows = self._rows("vectors", "key long, embedding array<double>, version string, part int")
        return rows.where(F.col("version") == (version or "")).select("key", "embedding")

    def failed(self, version: str) -> DataFrame:
        """Keys that a version has no vector for."""
        return self._rows("failed", "key long, version string, part int").where(F.col("version") == version).select("key")

    def done_parts(self, version: str) -> set[int]:
        rows = self._rows("parts", "version string, part int, n_processed long, n_failed long")
        return {r.part for r in rows.where(F.col("version") == version).collect()}

    def re_embed(self, chunks: DataFrame, version: str, embed: Embed, parts: int = 8) -> DataFrame:
        """Compute all vectors of ``chunks(key, text)`` anew beside the old ones, then make them the current ones.

        ``embed`` maps ``(key, text)`` to ``(key, embedding)``; a chunk that it leaves out or gives no vector is listed as
        failed; a vector of zeros is none. A run that broke off is called again with the same version: parts that are committed are not computed
        again, and until the last one is, readers see the version before. Returns ``(version, n_processed, n_failed)``.
        """
        staged = f"{self.path}/staged/version={version}"
        if not stored_at(self.spark, f"{staged}/_SUCCESS"):
            part = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")
            chunks.select("key", "text", part.alias("part")).repartition("part", F.pmod(F.hash("key"), F.lit(64))).write.mode(
                "overwrite"
            ).partitionBy("part").parquet(staged)
        staged_rows = self.spark.read.schema("key long, text string, part int").parquet(staged)
        done = self.done_parts(version)
        for p in range(parts):
            if p in done:
                continue
            mine = staged_rows.where(F.col("part") == p).select("key", "text")
            at = f"version={version}/part={p}"
            got = embed(mine).where(F.exists("embedding", lambda x: x != 0)).select("key", F.col("embedding").cast("array<double>").alias("embedding"))
            got.write.mode("overwrite").parquet(f"{self.path}/vectors/{at}")
            got = self.spark.read.parquet(f"{self.path}/vectors/{at}")
            mine.select("key").join(got, "key", "left_anti").write.mode("overwrite").parquet(f"{self.path}/failed/{at}")
            n_failed = self.spark.read.parquet(f"{self.path}/failed/{at}").count()
            self._add("parts", (version, p, got.count(), n_failed), "version string, part int, n_processed long, n_failed long")
        if self.current() != version:
            number = self._rows("manifest", "version string, number int").count()
            self._add("manifest", (version, number), "version string, number int")
        rows = self._rows("parts", "version string, part int, n_processed long, n_failed long").where(F.col("version") == version)
        return rows.groupBy("version").agg(F.sum("n_processed").alias("n_processed"), F.sum("n_failed").alias("n_failed"))
