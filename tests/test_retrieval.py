import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.functions import vectors as V
from leafmill.operators import evaluation as E
from leafmill.operators import joins as J
from leafmill.operators import retrieval as R

DOCS = [(1, "the cat sat on the mat"), (2, "the dog ate the cat food"), (3, "birds fly south"), (4, ""), (5, "the the the dog")]
QUERIES = [(1, "cat food cat"), (2, "the dog"), (3, "nothing here")]


def brute_bm25(query):
    toks = {d: re.findall(r"\b\w{2,}\b", t.lower()) for d, t in DOCS}
    toks = {d: t for d, t in toks.items() if t}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(w for t in toks.values() for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if x < 0 else x for w, x in idf.items()}
    out = {}
    for d, t in toks.items():
        tf = Counter(t)
        s = sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in re.findall(r"\w{2,}", query))
        if s > 0:
            out[d] = round(s, 6)
    return out


@pytest.mark.parametrize("limit", [0, 500_000])
def test_bm25(spark, monkeypatch, limit):
    if not limit:
        monkeypatch.setattr(R, "is_small", lambda df: False)
    docs = spark.createDataFrame(DOCS, "doc_id int, text string")
    qs = spark.createDataFrame(QUERIES, "query_id int, text string")
    got = R.bm25_topk(qs, docs, 10).collect()
    for qid, text in QUERIES:
        assert {r["doc_id"]: r["score"] for r in got if r["query_id"] == qid} == pytest.approx(brute_bm25(text), abs=1e-6)


@pytest.mark.parametrize("block_bytes", [None, 200])
def test_dense_blocks_agree(spark, block_bytes):
    rng = np.random.default_rng(1)
    vecs, qs = rng.normal(size=(150, 8)), rng.normal(size=(7, 8))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vecs)], "vec_id int, embedding array<double>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(qs)], "query_id int, embedding array<double>")
    v = v.unionByName(spark.createDataFrame([(900, []), (901, None)], v.schema))
    assert sorted(r["vec_id"] for r in R.without_vector(v).collect()) == [900, 901]
    got = R.dense_topk(q, v, 5, block_bytes).toPandas()
    sims = (qs / np.linalg.norm(qs, axis=1)[:, None]) @ (vecs / np.linalg.norm(vecs, axis=1)[:, None]).T
    for i in range(7):
        mine = got[got["query_id"] == i].sort_values("rank")["vec_id"].tolist()
        assert mine == list(np.argsort(-np.round(sims[i], 6), kind="stable")[:5])


def test_hash_embed_unit(spark):
    df = spark.createDataFrame([(1, "Alpha beta beta"), (2, "gamma")], "id int, text string")
    tok = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))
    for r in V.hash_embed(df, "id", tok, 16).collect():
        assert len(r["embedding"]) == 16 and np.linalg.norm(r["embedding"]) == pytest.approx(1.0)


def test_rrf_weights(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, item string, rank int")
    b = spark.createDataFrame([(1, "y", 1)], "query_id int, item string, rank int")
    got = {r["item"]: r for r in R.rrf({"a": a, "b": b}, [3, 1], "item").collect()}
    assert got["y"]["rrf_score"] == pytest.approx(0.75 / 62 + 0.25 / 61) and got["x"]["rank_b"] is None
    even = {r["item"]: r["rrf_score"] for r in R.rrf({"a": a, "b": b}, [1, 2, 3], "item").collect()}
    assert even["x"] == pytest.approx(0.5 / 61)
    with pytest.raises(ValueError):
        R.check_profile(0.5, 0.6)


def test_metrics_facts(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "query_id int, item string, rank int")
    truth = spark.createDataFrame([(1, "b")], "query_id int, item string")
    m = {r["query_id"]: r for r in E.retrieval_metrics(ranked, truth, 5, "item").collect()}
    assert (m[1]["precision"], m[1]["recall"], m[1]["reciprocal_rank"]) == (0.5, 1.0, 0.5)
    assert m[2]["recall"] == 1.0 and not m[2]["hit"]


def test_intervals_edges(spark):
    p = spark.createDataFrame([(1, 5.0), (1, 10.0), (1, 12.0), (1, 30.0)], "k int, at double")
    i = spark.createDataFrame([(1, 0.0, 10.0, "A"), (1, 10.0, 11.0, "B"), (1, 29.0, 95.0, "C")], "k int, start double, end double, label string")
    got = {r["at"]: r["label"] for r in J.points_in_intervals(p, i, "k", "at", "start", "end", 7.0).collect()}
    assert got == {5.0: "A", 10.0: "A", 12.0: None, 30.0: "C"}
    twice = J.points_in_intervals(p.unionByName(p), i, "k", "at", "start", "end", 7.0)
    assert twice.count() == 8 and twice.columns == ["k", "at", "label"]


def test_merge_context_limits(spark):
    from pyspark.sql import functions as F

    parts = F.expr("array(struct('s' as source, 0 as page, 'abcdef' as text), struct('t' as source, 4 as page, 'xyz' as text))")
    row = spark.range(1).select(
        R.merge_context(F.lit("graph"), parts).alias("all"),
        R.merge_context(F.lit(" "), parts, per_part=3, max_parts=1).alias("few"),
        R.merge_context(F.lit("graph text"), parts, total=20).alias("short"),
        R.merge_context(F.lit(None).cast("string"), F.expr("array()").cast("array<struct<source:string,page:int,text:string>>")).alias("none"),
    ).first()
    assert row.all == "=== Knowledge Graph Context ===\ngraph\n\n===\n\n=== Vector Search Context ===\n[SOURCE: s, page 1]\nabcdef\n\n---\n\n[SOURCE: t, page 5]\nxyz"
    assert row.few == "=== Vector Search Context ===\n[SOURCE: s, page 1]\nabc..."
    assert row.short == "=== Knowledge Graph ..." and row.none == ""
