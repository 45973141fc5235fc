"""Keyword, dense and hybrid retrieval over whole collections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators.joins import is_small
from leafmill.operators.ranking import top_k_per_key

# Keyword ranking and fusion constants.
K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60


def bm25_postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, dl, term, tf); documents without tokens are skipped. A document's terms combine before the shuffle."""
    tok = docs.select(key, X.tokenize_words(F.col(text)).alias("_t"))
    return (
        tok.select(key, F.size("_t").alias("dl"), F.explode("_t").alias("term"))
        .groupBy(key, "dl", "term")
        .agg(F.count("*").alias("tf"))
    )


def bm25_terms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def bm25_scores(queries: DataFrame, docs: DataFrame, key: str = "doc_id", query_key: str = "query_id") -> DataFrame:
    """(query, doc, score) for every pair that shares a term; repeated query terms add repeatedly.

    Queries meet documents only through terms; tokens nobody asked for are dropped before the first shuffle when
    the asked terms are few enough to broadcast. Corpus statistics are scalar subqueries.
    """
    # empty documents fall out at explode; a filter on the tokens would tokenize every text once more
    tok = docs.select(key, X.tokenize_words(F.col("text")).alias("_t"))
    dl = tok.select(F.size("_t").alias("dl"))
    corpus = dl.select(F.struct(F.count_if(F.col("dl") > 0).alias("n"), F.avg(F.nullif("dl", F.lit(0))).alias("avgdl"))).scalar()
    n, avgdl = corpus["n"], corpus["avgdl"]

    def raw_idf(n_docs):
        return F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)

    terms = tok.select(F.explode(F.array_distinct("_t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    floor = terms.select(F.avg(raw_idf(n)) * EPSILON).scalar()
    q = (
        queries.select(query_key, F.explode(X.tokenize_words(F.col("text"))).alias("term"))
        .groupBy(query_key, "term")
        .agg(F.count("*").alias("qtf"))
    )
    small = is_small(q)
    asked = q.select("term").distinct()
    asked = F.broadcast(asked) if small else asked
    idf = terms.join(asked, "term", "left_semi").select("term", F.when(raw_idf(n) < 0, floor).otherwise(raw_idf(n)).alias("idf"))
    weights = q.join(idf, "term").select(query_key, "term", (F.col("qtf") * F.col("idf")).alias("w"))
    rows = tok.select(key, F.size("_t").alias("dl"), F.explode("_t").alias("term")).join(asked, "term", "left_semi")
    if small:
        # weights have at most as many rows as q; with documents co-located both groupings need no further shuffle
        rows, weights = rows.repartition(key), F.broadcast(weights)
    post = rows.groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    tf = F.col("tf")
    part = F.col("w") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / avgdl))
    return post.join(weights, "term").groupBy(query_key, key).agg(F.sum(part).alias("score")).where("score > 0")


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int, key: str = "doc_id", query_key: str = "query_id") -> DataFrame:
    scored = bm25_scores(queries, docs, key, query_key).withColumn("score", F.round("score", 6))
    return top_k_per_key(scored, [query_key], "score", key, k)


#: Bytes of query vectors (as doubles) that meet the vectors in one pass, and vectors that are compared at once.
BLOCK_BYTES, STEP = 32 << 20, 1024


def _best(qid: np.ndarray, qmat: np.ndarray, vid: np.ndarray, vmat: np.ndarray, k: int) -> pd.DataFrame:
    """Top k vectors per query within one block; ties at the cut are kept so that ids decide later."""
    vn = np.linalg.norm(vmat, axis=1)
    sims = np.round(qmat @ (vmat / np.where(vn > 1e-12, vn, 1.0)[:, None]).T, 6) + 0.0
    if sims.shape[1] > k:
        cut = -np.partition(-sims, k - 1, axis=1)[:, k - 1]
        rows, cols = np.nonzero(sims >= cut[:, None])
    else:
        rows, cols = np.indices(sims.shape).reshape(2, -1)
    return _cut(pd.DataFrame({"query_id": qid[rows], "vec_id": vid[cols], "score": sims[rows, cols]}), k)


def _cut(best: pd.DataFrame, k: int) -> pd.DataFrame:
    return best.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)


def _unit(rows) -> np.ndarray:
    m = np.array([np.asarray(r, dtype="float64") for r in rows])
    n = np.linalg.norm(m, axis=1)
    return m / np.where(n > 1e-12, n, 1.0)[:, None]


def without_vector(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows that no vector search can find: null or empty vectors."""
    return df.where(F.coalesce(F.size(column), F.lit(-1)) <= 0)


def query_blocks(queries: DataFrame, block_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries' ids and unit vectors, block by block; each block is at most ``block_bytes`` on average."""
    kept = queries.where(F.size("embedding") > 0).select("query_id", "embedding")
    n, dim = kept.agg(F.count("*"), F.max(F.size("embedding"))).first()
    blocks = max(1, -(-n * (dim or 0) * 8 // block_bytes))
    for i in range(blocks):
        rows = kept.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()
        if rows:
            yield np.array([r[0] for r in rows]), _unit([r[1] for r in rows])


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, block_bytes: int | None = None) -> DataFrame:
    """Exact cosine top-k: queries(query_id, embedding) against vectors(vec_id, embedding).

    The queries are a stated set and come in blocks of ``block_bytes``; each block meets every vector where the vector
    is read, so vectors are neither shuffled nor counted first. A task gives at most k rows per query, and the last cut
    ranks those. Rows of ``without_vector`` take no part.
    """
    qt, vt = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["vec_id"]
    held = vectors.where(F.size("embedding") > 0).select("vec_id", "embedding")
    schema = f"query_id {qt}, vec_id {vt}, score double"
    out = vectors.sparkSession.createDataFrame([], schema)
    for qid, qmat in query_blocks(queries, block_bytes or BLOCK_BYTES):

        def best(batches: Iterator[pd.DataFrame], qid=qid, qmat=qmat) -> Iterator[pd.DataFrame]:
            kept: list[pd.DataFrame] = []
            for pdf in batches:
                ids = pdf["vec_id"].to_numpy()
                for i in range(0, len(pdf), STEP):
                    vecs = np.array(pdf["embedding"].iloc[i : i + STEP].tolist(), dtype="float64")
                    kept.append(_best(qid, qmat, ids[i : i + STEP], vecs, k))
                    if len(kept) == 16:
                        kept = [_cut(pd.concat(kept), k)]
            if kept:
                yield _cut(pd.concat(kept), k)

        out = out.unionByName(held.mapInPandas(best, schema))
    return top_k_per_key(out, ["query_id"], "score", "vec_id", k)


def rrf(lists: dict[str, DataFrame], weights: list[float] | None, key: str, query_key: str = "query_id", k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of (query, key, rank) lists; keeps each list's rank.

    Weights are scaled to sum 1; a wrong number of weights means equal ones.
    """
    n = len(lists)
    if weights is not None and len(weights) != n:
        weights = [1.0 / n] * n
    if weights and sum(weights) > 0:
        weights = [w / sum(weights) for w in weights]
    weights = weights or [1.0] * n
    parts = None
    for (name, df), w in zip(lists.items(), weights):
        p = df.select(query_key, key, F.lit(name).alias("_src"), F.col("rank").alias("_rank"), (F.lit(w) / (F.lit(k) + F.col("rank"))).alias("_s"))
        parts = p if parts is None else parts.unionByName(p)
    return parts.groupBy(query_key, key).agg(
        F.sum("_s").alias("rrf_score"),
        *[F.max(F.when(F.col("_src") == s, F.col("_rank"))).alias(f"rank_{s}") for s in lists],
    )


def minmax(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Scale scores to [0, 1] per key; a flat list becomes 0 over a range of 1."""
    ends = df.groupBy(*keys).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    span = F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise(F.col("_hi") - F.col("_lo"))
    return df.join(ends, keys).withColumn(score, (F.col(score) - F.col("_lo")) / span).drop("_lo", "_hi")


def minmax_fusion(lists: dict[str, DataFrame], weights: list[float], key: str, query_key: str = "query_id") -> DataFrame:
    """Weighted sum of scores that are scaled to [0, 1] per query and list; a list that lacks a key adds nothing.

    Lists are (query, key, score); weights are scaled to sum 1.
    """
    if len(weights) != len(lists) or min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("one weight for each list, none below 0 and not all 0")
    parts = None
    for (name, df), w in zip(lists.items(), weights):
        p = minmax(df.select(query_key, key, "score"), [query_key], "score")
        p = p.select(query_key, key, F.lit(name).alias("_src"), F.col("score").alias("_unit"), (F.lit(w / sum(weights)) * F.col("score")).alias("_s"))
        parts = p if parts is None else parts.unionByName(p)
    return parts.groupBy(query_key, key).agg(
        F.sum("_s").alias("fused_score"),
        *[F.max(F.when(F.col("_src") == s, F.col("_unit"))).alias(f"unit_{s}") for s in lists],
    )


# Keyword and vector weight per profile; fallback is general.
PROFILES = {
    "general": (0.5, 0.5),
    "legal": (0.7, 0.3),
    "technical": (0.4, 0.6),
    "financial": (0.6, 0.4),
}


def profile_weight(profile: Column, which: int) -> Column:
    out = F.lit(PROFILES["general"][which])
    for name, pair in PROFILES.items():
        out = F.when(profile == name, pair[which]).otherwise(out)
    return out


def check_profile(keyword: float, vector: float) -> None:
    if min(keyword, vector) < 0 or abs(keyword + vector - 1) > 0.01:
        raise ValueError("weights must be non-negative and sum to 1")


def hybrid(sparse: DataFrame, dense: DataFrame, key: str, k: int, profile: Column | None = None) -> DataFrame:
    """Fuse the two ranked lists, keep both scores (0 where absent), cut to k per query."""
    s = sparse.select("query_id", key, F.col("score").alias("bm25_score"), F.col("rank").alias("rank_s"))
    d = dense.select("query_id", key, F.col("score").alias("dense_score"), F.col("rank").alias("rank_d"))
    prof = profile if profile is not None else F.lit("general")

    def term(which: int, rank: str) -> Column:
        return F.coalesce(profile_weight(prof, which) / (RRF_K + F.col(rank)), F.lit(0.0))

    both = s.join(d, ["query_id", key], "full").na.fill(0.0, ["bm25_score", "dense_score"])
    fused = both.withColumn("rrf_score", F.round(term(0, "rank_s") + term(1, "rank_d"), 9)).drop("rank_s", "rank_d")
    return top_k_per_key(fused, ["query_id"], "rrf_score", key, k)


def hybrid_score(dense: Column, sparse: Column, alpha: float) -> Column:
    def unit(c):
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    return unit(dense) * alpha + unit(sparse) * (1 - alpha)


def rerank_score(logit: Column) -> Column:
    x = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), logit))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def lexical_logit(query: Column, text: Column) -> Column:
    """Default scorer: share of distinct query tokens found in the text, centred on one half."""
    q = F.array_distinct(X.tokenize_words(query))
    hit = F.size(F.array_intersect(q, X.tokenize_words(text)))
    return (hit / F.greatest(F.size(q), F.lit(1)) - 0.5) * 8


def extractive_answer(hits: DataFrame, n_lines: int = 2, max_rank: int | None = None) -> DataFrame:
    """Best ``n_lines`` first sentences of the hits (query_id, question, text, score, rank, source, page)."""
    flat = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    terms = F.transform(
        F.filter(F.array_distinct(F.transform(X.split_space(F.col("question")), F.lower)), lambda w: F.length(w) > 2),
        lambda w: F.contains(F.lower(F.col("flat")), w).cast("int"),
    )
    top = (hits if max_rank is None else hits.where(F.col("rank") <= max_rank)).withColumn("flat", flat).where("flat <> ''")
    first = F.trim(F.substring_index("flat", ". ", 1))
    overlap = F.aggregate(terms, F.lit(0), lambda a, x: a + x) + F.greatest(F.col("score"), F.lit(0.0))
    line = F.concat(F.lit("- "), first, F.lit(" [SOURCE: "), "source", F.lit(", page "), F.col("page") + 1, F.lit("]"))
    lines = F.sort_array(F.collect_list(F.struct(overlap.alias("o"), (-F.col("rank")).alias("r"), line.alias("line"))), asc=False)
    best = F.transform(F.slice(lines, 1, n_lines), lambda s: s["line"])
    return top.groupBy("query_id").agg(
        F.concat_ws("\n", F.lit("Extractive answer from indexed text:"), F.array_join(best, "\n")).alias("answer")
    )


def build_context(hits: DataFrame, max_docs: int | None = None, snippet: int | None = None) -> DataFrame:
    """Context text with source markers and the citations behind it, in rank order, for the hits of each query.

    ``max_docs`` and ``snippet`` (characters) leave out more if they are given.
    """
    shown = F.substring("text", 1, snippet) if snippet else F.col("text")
    hits = hits if max_docs is None else hits.where(F.col("rank") <= max_docs)
    part = F.concat(
        F.lit("[SOURCE: "), "source", F.lit(", page "), F.col("page") + 1, F.lit("]\n"),
        X.escape_prompt(shown),
    )
    cite = F.struct(
        "rank", "source", (F.col("page") + 1).alias("page"), shown.alias("text"), "score", F.col("doc_id").alias("id")
    )
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))), lambda s: s["p"])
    body = F.array_join(parts, "\n\n---\n\n")
    return hits.groupBy("query_id").agg(
        F.concat(F.lit("<document_context>\n"), body, F.lit("\n</document_context>")).alias("context"),
        F.count("*").alias("n_citations"),
        F.array_sort(F.collect_list(cite)).alias("citations"),
    )


def merge_context(
    graph: Column, parts: Column, total: int | None = None, per_part: int | None = None, max_parts: int | None = None
) -> Column:
    """Graph text and marked parts joined; ``parts`` is array<struct<source, page, text>>.

    Limits leave out more where they are given: ``max_parts`` parts, ``per_part`` characters of each, ``total``
    characters in all, half of them for either side.
    """

    def cut(text: Column, most: int | None, mark: str) -> Column:
        if most is None:
            return text
        return F.concat(F.substring(text, 1, most), F.when(F.length(text) > most, mark).otherwise(""))

    half = None if total is None else total // 2
    g = F.when(
        F.trim(F.coalesce(graph, F.lit(""))) != "",
        F.concat(F.lit("=== Knowledge Graph Context ===\n"), cut(graph, half, "")),
    )
    texts = F.transform(
        parts if max_parts is None else F.slice(parts, 1, max_parts),
        lambda p: F.concat(
            F.lit("[SOURCE: "), p["source"], F.lit(", page "), (p["page"] + 1).cast("string"), F.lit("]\n"),
            cut(p["text"], per_part, "..."),
        ),
    )
    joined = cut(F.array_join(texts, "\n\n---\n\n"), half, "\n\n[...truncated...]")
    v = F.when(F.size(parts) > 0, F.concat(F.lit("=== Vector Search Context ===\n"), joined))
    return cut(F.array_join(F.array_compact(F.array(g, v)), "\n\n===\n\n"), total, "...")


def keyword_search(queries: DataFrame, kb: DataFrame, k: int = 5) -> DataFrame:
    """Shared distinct tokens between query and entry; entries meet queries only through tokens."""
    q = queries.select("query_id", F.explode(F.array_distinct(X.tokenize_any(F.col("text")))).alias("tok"))
    e = kb.select("entry_id", F.explode(F.array_distinct(X.tokenize_any(F.col("text")))).alias("tok"))
    hits = q.join(e, "tok").groupBy("query_id", "entry_id").agg(F.count("*").alias("overlap"))
    return top_k_per_key(hits, ["query_id"], "overlap", "entry_id", k)
