import numpy as np
import pytest

from leafmill.operators import retrieval as R
from leafmill.operators.vectorindex import VectorIndex, fit_centroids
from leafmill.sources.scratch import scratch_path


def hits(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def clustered(seed, n, dim=24, groups=40):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dim))
    return middle[rng.integers(0, groups, n)] + 0.5 * rng.normal(size=(n, dim))


def test_recall_exact_mode_and_pieces(spark):
    points = clustered(1, 4000)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(points)]
    rows += [(4000, None), (4001, []), (4002, rows[5][1]), (4003, [0.0] * 24)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    queries = spark.createDataFrame([(i, v) for i, v in rows[:3000:50]] + [(9999, [0.0] * 24)], "query_id long, embedding array<double>")
    index = VectorIndex.build(vectors, scratch_path(spark, "vectors"), piece_bytes=4096)
    assert index.vectors().count() == 4002 and index.centroids().agg({"n": "sum"}).first()[0] == 4002
    assert index.vectors().inputFiles() and len(index.vectors().inputFiles()) > index.centroids().count()  # cells in pieces
    want = hits(R.dense_topk(queries, vectors, 10))
    assert hits(index.search(queries, 10)) == want
    assert hits(index.search(queries, 10, block_bytes=24 * 8 * 7)) == want
    real = {(q, v) for q, _, v, _ in want if q != 9999}
    some = {(q, v) for q, _, v, _ in hits(index.search(queries, 10, probes=8)) if q != 9999}
    assert len(real & some) >= 0.9 * len(real)


def test_table_of_embeddings(spark, sf):
    """The number of cells to probe is found on some queries and holds for others."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    fitted, others = queries.where("query_id % 20 = 0"), queries.where("query_id % 20 <> 0")
    index = VectorIndex.build(vectors, scratch_path(spark, "vectors"))
    probes = index.probes_for(fitted, 10, 0.95)
    want = hits(R.dense_topk(others, vectors, 10))
    assert hits(index.search(others, 10)) == want
    some = {(q, v) for q, _, v, _ in hits(index.search(others, 10, probes))}
    assert len({(q, v) for q, _, v, _ in want} & some) >= 0.9 * len(want)


def test_small_and_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    assert hits(VectorIndex.build(empty, scratch_path(spark, "vectors")).search(queries, 3)) == []
    one = spark.createDataFrame([(7, [2.0, 0.0])], "vec_id long, embedding array<double>")
    assert hits(VectorIndex.build(one, scratch_path(spark, "vectors")).search(queries, 3)) == [(1, 1, 7, 1.0)]


def test_centroids_leave_no_cell_empty():
    unit = clustered(2, 300)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    c = fit_centroids(unit, 30)
    assert np.linalg.norm(c, axis=1) == pytest.approx(np.ones(30))
