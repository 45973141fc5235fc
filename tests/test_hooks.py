import pandas as pd
from pyspark.sql import functions as F

from leafmill.functions import hooks as H


def test_rerank_default_and_scorer(spark):
    hits = spark.createDataFrame([(1, 1, "red cat", "a red cat"), (1, 2, "red cat", "blue dog")], "query_id int, doc_id int, question string, text string")
    assert [r["doc_id"] for r in H.rerank(hits, 5, 0.3).collect()] == [1]
    got = H.rerank(hits, 1, 0.0, lambda q, t: t.str.len().astype(float) - 8).collect()
    assert [r["doc_id"] for r in got] == [1]


def test_embedder(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "")], "id int, t string")
    got = {r["id"]: r["embedding"] for r in H.embed(df, "id", "t", lambda s: s.map(lambda x: [float(len(x)), 1.0])).collect()}
    assert got == {1: [3.0, 1.0], 2: [0.0, 1.0]}
    assert len(H.embed(df, "id", "t", dim=8).first()["embedding"]) == 8


def test_retriever(spark):
    q = spark.createDataFrame([(1,)], "query_id int")
    truth = spark.createDataFrame([(1, "a")], "query_id int, item string")
    r = H.evaluate_retriever(q, truth, lambda d: d.withColumn("item", F.lit("a")).withColumn("rank", F.lit(1)), 3, "item").first()
    assert r["precision"] == 1.0


def test_splitter_udtf(spark):
    spark.udtf.register("split_text", H.SplitText)
    rows = spark.sql("select d.id, s.* from values (1, 'aaa bbb ccc'), (2, 'x') as d(id, t), lateral split_text(d.t, 7, 0) s").collect()
    assert {(r["id"], r["chunk_index"], r["chunk"]) for r in rows} == {(1, 0, "aaa bbb"), (1, 1, "ccc"), (2, 0, "x")}


def test_extractor(spark):
    df = spark.createDataFrame([(1, "x")], "id int, t string")
    got = H.extract_json(df, "id", "t", lambda s: pd.Series(['```json\n{"a": 1}\n```'] * len(s))).first()
    assert got["json"] == '{"a": 1}'
