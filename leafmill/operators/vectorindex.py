"""Vectors stored in cells around centroids, searched by probing a query's nearest cells or exactly.

``cells/cell=C/piece=P`` holds the unit vectors nearest to centroid C; a cell beyond a number of bytes is cut into
pieces by a hash, so neither a file nor a task grows with the most crowded cell. ``centroids`` has a row per cell with
its radius and size. Centroids are fitted on a bounded sample; every vector is stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.ranking import top_k_per_key
from leafmill.operators.retrieval import BLOCK_BYTES, STEP, _best, _cut, _unit, query_blocks

#: Vectors that the centroids are fitted on, rounds of fitting, bytes of a piece.
SAMPLE, ROUNDS, PIECE_BYTES = 20_000, 8, 64 << 20
#: Scores are rounded to six decimals; bounds are loosened by more than that.
SLACK = 1e-5


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit vectors: a few rounds of k-means by cosine; empty cells start again at far vectors."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        sims = sample @ centroids.T
        near, best = sims.argmax(axis=1), sims.max(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        empty = np.flatnonzero(np.bincount(near, minlength=cells) == 0)
        sums[empty] = sample[np.argsort(best)[: len(empty)]]
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
    return centroids


class VectorIndex:
    """Cells of vectors in ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(
        cls, vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, piece_bytes: int = PIECE_BYTES
    ) -> VectorIndex:
        """Store ``vectors(vec_id, embedding)``; null and empty vectors are left out.

        ``cells`` defaults to the square root of the number of vectors, as far as the sample has 8 vectors for each.
        """
        spark = vectors.sparkSession
        held = vectors.where(F.size("embedding") > 0).select("vec_id", "embedding")
        n = held.count()
        few = held.sample(min(1.0, 1.2 * sample / max(n, 1)), 11).limit(sample).collect()
        points = _unit([r[1] for r in few]) if few else np.zeros((0, 1))
        cells = max(1, min(cells or round(n**0.5), len(points) // 8 or 1))
        centroids = fit_centroids(points, cells) if len(points) else np.zeros((1, 1))
        kind = dict(vectors.dtypes)["vec_id"]

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for i in range(0, len(pdf), STEP):
                    part = pdf.iloc[i : i + STEP]
                    unit = _unit(part["embedding"])
                    sims = unit @ centroids.T
                    cell = sims.argmax(axis=1)
                    far = np.linalg.norm(unit - centroids[cell], axis=1)
                    yield pd.DataFrame({"vec_id": part["vec_id"], "embedding": list(unit), "far": far, "cell": cell.astype("int32")})

        schema = f"vec_id {kind}, embedding array<double>, far double, cell int"
        pieces = max(1, -(-n * centroids.shape[1] * 8 // (cells * piece_bytes)))
        placed = held.mapInPandas(near, schema).withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.lit(pieces)).cast("int"))
        rows = max(1, piece_bytes // (centroids.shape[1] * 8))
        writer = placed.repartition("cell", "piece").write.option("maxRecordsPerFile", rows).mode("overwrite")
        writer.partitionBy("cell", "piece").parquet(f"{path}/cells")
        found = spark.read.schema(f"{schema}, piece int").parquet(f"{path}/cells")
        sizes = {r["cell"]: r for r in found.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()}
        rows = [(c, centroids[c].tolist(), float(sizes[c].radius), sizes[c].n) for c in sorted(sizes)]
        spark.createDataFrame(rows, "cell int, centroid array<double>, radius double, n long").coalesce(1).write.mode("overwrite").parquet(
            f"{path}/centroids"
        )
        return cls(spark, path)

    def centroids(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/centroids")

    def vectors(self) -> DataFrame:
        if self.centroids().isEmpty():
            return self.spark.createDataFrame([], "vec_id long, embedding array<double>, far double, cell int")
        rows = self.spark.read.parquet(f"{self.path}/cells")
        return rows.select("vec_id", "embedding", "far", F.col("cell").cast("int").alias("cell"))

    def search(self, queries: DataFrame, k: int, probes: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
        """``(query_id, vec_id, score, rank)``: the best ``k`` vectors by cosine of ``queries(query_id, embedding)``.

        With ``probes`` only that many nearest cells are read for each query. Without, the result is exact: the nearest
        cell gives a score that the k-th hit must reach at least, and by the triangle inequality a cell whose centroid
        is further off than that score's distance and the cell's radius holds no hit; all other cells are read.
        """
        vectors, kinds = self.vectors(), (dict(queries.dtypes)["query_id"], dict(self.vectors().dtypes)["vec_id"])
        known = sorted(self.centroids().collect(), key=lambda r: r["cell"])
        out = self.spark.createDataFrame([], f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")
        if not known:
            return top_k_per_key(out, ["query_id"], "score", "vec_id", k)
        names = np.array([r["cell"] for r in known])
        middle, radius = np.array([r.centroid for r in known]), np.array([r.radius for r in known])
        sizes = np.array([r.n for r in known])
        for qid, qmat in query_blocks(queries, block_bytes):
            off = np.sqrt(np.maximum((qmat**2).sum(1)[:, None] + (middle**2).sum(1)[None, :] - 2 * qmat @ middle.T, 0))
            order = np.argsort(off, axis=1, kind="stable")
            wanted = np.zeros(off.shape, bool)
            if probes is not None:
                np.put_along_axis(wanted, order[:, :probes], True, axis=1)
            else:
                # As many nearest cells as hold k vectors: their k-th score is what every hit must reach.
                enough = np.cumsum(sizes[order], axis=1) - sizes[order] < k
                first = np.zeros(off.shape, bool)
                np.put_along_axis(first, order, enough, axis=1)
                ahead = self._probe(vectors, names, first, qid, qmat, k, kinds)
                least = dict.fromkeys(qid.tolist(), -1.0)
                for r in top_k_per_key(ahead, ["query_id"], "score", "vec_id", k).where(F.col("rank") == k).collect():
                    least[r["query_id"]] = r["score"]
                reach = np.sqrt(np.maximum(2 - 2 * (np.array([least[q] for q in qid.tolist()]) - SLACK), 0))
                wanted = off <= reach[:, None] + radius[None, :] + SLACK
            out = out.unionByName(self._probe(vectors, names, wanted, qid, qmat, k, kinds))
        return top_k_per_key(out, ["query_id"], "score", "vec_id", k)

    def probes_for(self, queries: DataFrame, k: int, recall: float = 0.9) -> int:
        """The fewest cells, doubling from one, whose probing finds ``recall`` of the exact hits of these sample queries."""
        cells = self.centroids().count()
        want = {(r["query_id"], r["vec_id"]) for r in self.search(queries, k).collect()}
        probes = 1
        while probes < cells:
            found = {(r["query_id"], r["vec_id"]) for r in self.search(queries, k, probes).collect()}
            if len(found & want) >= recall * len(want):
                break
            probes *= 2
        return min(probes, max(cells, 1))

    @staticmethod
    def _probe(vectors: DataFrame, names: np.ndarray, wanted: np.ndarray, qid: np.ndarray, qmat: np.ndarray, k: int, kinds) -> DataFrame:
        """Best ``k`` per task of the queries' wanted cells; other cells are not read."""
        of_cell = {int(names[c]): np.flatnonzero(wanted[:, c]) for c in np.flatnonzero(wanted.any(axis=0))}

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept: list[pd.DataFrame] = []
            for pdf in batches:
                for cell, rows in pdf.groupby("cell"):
                    asked = of_cell[int(cell)]
                    for i in range(0, len(rows), STEP):
                        part = rows.iloc[i : i + STEP]
                        kept.append(_best(qid[asked], qmat[asked], part["vec_id"].to_numpy(), np.array(part["embedding"].tolist()), k))
                if len(kept) > 16:
                    kept = [_cut(pd.concat(kept), k)]
            if kept:
                yield _cut(pd.concat(kept), k)

        few = vectors.where(F.col("cell").isin(list(of_cell))).select("vec_id", "embedding", "cell")
        return few.mapInPandas(best, f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")
