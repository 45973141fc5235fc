import math
import re
from collections import Counter

import numpy as np
import pytest

from leafmill.operators import textindex as T
from leafmill.sources.scratch import scratch_path

WORDS = re.compile(r"\b\w{2,}\b")


def brute(queries, docs, k):
    """Okapi scores with floored weights, over all documents with a token."""
    cut = {d: Counter(WORDS.findall((t or "").lower())) for d, t in docs}
    cut = {d: c for d, c in cut.items() if c}
    n = len(cut)
    length = {d: sum(c.values()) for d, c in cut.items()}
    avg = sum(length.values()) / n
    df = Counter(w for c in cut.values() for w in c)
    raw = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    out = []
    for q, text in queries:
        scores = Counter()
        for w in WORDS.findall((text or "").lower()):
            for d, c in cut.items():
                if c[w]:
                    idf = raw[w] if raw[w] >= 0 else floor
                    scores[d] += idf * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * length[d] / avg))
        best = sorted(((-round(s, 6), d) for d, s in scores.items() if s > 0))[:k]
        out += [(q, d, pytest.approx(-s, abs=2e-6), i) for i, (s, d) in enumerate(best, 1)]
    return sorted(out, key=lambda r: (r[0], r[3]))


def make(seed, n, start=0):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, 401)
    p /= p.sum()
    return [(start + i, " ".join(f"w{x}" for x in rng.choice(400, rng.integers(0, 90), p=p))) for i in range(n)]


def found(index, queries, k, spark):
    rows = index.search(spark.createDataFrame(queries, "query_id int, text string"), k).collect()
    return sorted(((r.query_id, r.doc_id, r.score, r.rank) for r in rows), key=lambda r: (r[0], r[3]))


@pytest.fixture
def index(spark):
    return T.TextIndex(spark, scratch_path(spark, "test-index"))


def add(index, spark, name, docs):
    return index.add(name, spark.createDataFrame(docs, "doc_id long, text string").repartition(3))


def test_segments_replay_and_compaction(spark, index):
    """Results over several segments equal those over all documents; a replayed segment adds nothing."""
    parts = [make(1, 500), make(2, 300, 1000), [(5000, None), (5001, "?!"), (5002, "w1 w1 W1 w399")]]
    queries = [(i, t) for i, (_, t) in enumerate(make(9, 12))] + [(90, "w1 w1 w2"), (91, ""), (92, "unseen"), (93, None)]
    for i, p in enumerate(parts):
        assert add(index, spark, f"s{i}", p)
    assert not add(index, spark, "s1", parts[1])
    every = [d for p in parts for d in p]
    want = brute(queries, every, 7)
    assert found(index, queries, 7, spark) == want
    assert index.compact("all") and index.segments() == ["all"] and not index.compact("all2")
    assert not add(index, spark, "s1", parts[1])
    assert found(index, queries, 7, spark) == want
    assert index.info().first().n_docs == index.documents().count() == sum(1 for _, t in every if WORDS.findall((t or "").lower()))


def test_many_blocks_of_queries(spark, index, monkeypatch):
    monkeypatch.setattr(T, "PAGE_DOCS", 4)
    docs = make(3, 600) + [(9000 + i, f"rare{i % 3} rare{i % 3} w1 w2") for i in range(30)]
    add(index, spark, "s", docs)
    queries = [(0, "rare0 w1 w2 w3"), (1, "rare1 rare2"), (2, "w1 w2"), (3, "w7 w50 w300"), (4, "w1"), (5, "rare0"), (6, "w2 w2")]
    q = spark.createDataFrame(queries, "query_id int, text string")
    rows = index.search(q, 5, block=2).collect()
    assert sorted(((r.query_id, r.doc_id, r.score, r.rank) for r in rows), key=lambda r: (r[0], r[3])) == brute(queries, docs, 5)


def test_pages_are_skipped_without_loss():
    """A page whose bounds cannot reach the k-th best score is not scored, and nothing is lost by that."""
    rng = np.random.default_rng(8)
    n_terms, avgdl = 30, 50.0
    weights = T.Weights(4, rng.integers(0, 4, 40), np.arange(40) % n_terms, rng.random(40) * 5)
    skipping, every = T.Best(4, 3), T.Best(4, 3)
    every.k = 10**6  # never learns what to skip
    for p in range(200):
        terms = np.sort(rng.choice(n_terms, 6, replace=False))
        keys = [np.sort(rng.choice(8, rng.integers(1, 8), replace=False)) + p * 8 for _ in terms]
        tfs = [rng.integers(1, 3 if p % 10 else 30, len(x)) for x in keys]
        dls = [20 + x % 60 for x in keys]
        top = [max(t * 2.5 / (t + 1.5 * (0.25 + 0.75 * d / avgdl))) for t, d in zip(tfs, dls)]
        for b in (skipping, every):
            b.page(weights, 1.0, avgdl, terms, top, keys, tfs, dls)
            b.result()
    query, key, score = every.result()
    place = np.arange(len(query)) - np.searchsorted(query, query)
    want = [(int(q), int(k), float(s)) for q, k, s, p in zip(query, key, score, place) if p < 3]
    assert [(int(q), int(k), float(s)) for q, k, s in zip(*skipping.result())] == want
    assert skipping.skipped > 200 and every.skipped == 0


def test_uncommitted_leftovers_do_not_count(spark, index):
    add(index, spark, "s0", [(1, "aa bb"), (2, "bb cc"), (3, "dd ee")])
    index.postings().where("term = 'bb'").drop("segment").write.partitionBy("part").parquet(f"{index.path}/postings/segment=torn")
    assert index.segments() == ["s0"] and index.terms().where("term = 'bb'").first().df == 2
    assert add(index, spark, "torn", [(4, "bb ff")]) and index.terms().where("term = 'bb'").first().df == 3
    with pytest.raises(ValueError):
        add(index, spark, "7", [(5, "x")])


def test_vectors_and_empty_index(spark, index):
    queries = [(1, "aa")]
    assert found(index, queries, 3, spark) == [] and index.vectors().count() == 0
    docs = spark.createDataFrame([(1, "aa bb"), (2, "cc dd"), (3, "ee ff")], "doc_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "key long, embedding array<double>")
    index.add("s0", docs, vectors=vectors)
    assert {r.key: r.embedding for r in index.vectors().collect()} == {1: [1.0, 0.0], 2: [0.0, 1.0]}
    assert [r[1] for r in found(index, queries, 3, spark)] == [1]


def test_postings_are_counted_where_the_page_is(spark, tmp_path):
    """Texts move once; no posting is shuffled by itself. Blocks are those that compaction makes by grouping."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 9) for _ in range(1 + (i + j) % 3))) for i in range(300)] + [(900, None)], "doc_id long, text string")
    plan = T.page_blocks(docs, "doc_id", "text", 5, 9.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan
    one, two = (T.TextIndex(spark, str(tmp_path / n)) for n in ("one", "two"))
    one.add("a", docs)
    two.add("a", docs.where("doc_id < 100"))
    two.add("b", docs.where("doc_id >= 100"))
    two.compact("c")
    rows = [sorted((r.term, r.page, r.n, round(r.top, 12), r.keys, r.tfs, r.dls, r.part) for r in x.postings().collect()) for x in (one, two)]
    assert rows[0] and rows[0] == rows[1]


def test_all_hits_of_a_query(spark, index, monkeypatch):
    """Without k every document with a score has a row, ranked over segments, bins of scores and ties."""
    monkeypatch.setattr(T, "BIN_DOCS", 100)
    parts = [make(21, 400), make(22, 300, 1000) + [(2000 + i, "w3 w7 w50") for i in range(90)]]
    queries = [(1, "w0 w5 w17 w5"), (2, "w3"), (3, "W50 nowhere"), (4, ""), (5, None)]
    for i, docs in enumerate(parts):
        add(index, spark, f"s{i}", docs)
    want = brute(queries, sum(parts, []), None)
    assert len(want) > 600
    assert found(index, queries, None, spark) == want
    nameless = index.search(spark.createDataFrame([(None, "w3"), (2, "w3")], "query_id int, text string"), None).collect()
    ranks = {q: sorted(r["rank"] for r in nameless if r.query_id == q) for q in (None, 2)}
    assert ranks[None] == ranks[2] == list(range(1, len(nameless) // 2 + 1))


def test_registered_scores_are_not_cut(spark, sf):
    from leafmill.operators import retrieval as R
    from leafmill.plans.retrieving import bm25_score, passages
    from leafmill.sources.tables import Tables

    t = Tables(spark, sf)
    got = {(r.query_id, r.doc_id): r["rank"] for r in bm25_score(t).collect()}
    scores = R.bm25_scores(passages(t), t.documents).selectExpr("query_id", "doc_id", "round(score, 6) AS score").where("score > 0")
    want = {(r.query_id, r.doc_id) for r in scores.collect()}
    assert set(got) == want and len(want) > 20 * len({q for q, _ in want})
    assert sorted(got.values())[-1] == max(sum(q == x for q, _ in want) for x in {q for q, _ in want})
