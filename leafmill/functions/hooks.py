"""Places where a caller plugs in a model: scorer, embedder, retriever, splitter, extractor.

Each hook is a batch function over pandas Series, so a model is loaded once per Python worker and fed by Arrow.
Defaults are native columns and need no model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import text as X
from leafmill.functions import vectors as V
from leafmill.operators.chunking import split_recursive
from leafmill.operators.ranking import threshold_top_k
from leafmill.operators.retrieval import lexical_logit, rerank_score

Scorer = Callable[[pd.Series, pd.Series], pd.Series]
Embedder = Callable[[pd.Series], pd.Series]


def rerank(hits: DataFrame, k: int, threshold: float, scorer: Scorer | None = None) -> DataFrame:
    """Rescore (query_id, doc_id, question, text) hits with ``scorer(question, text) -> logit`` and cut to k."""
    if scorer is None:
        logit: Column = lexical_logit(F.col("question"), F.col("text"))
    else:

        @F.pandas_udf(T.DoubleType())
        def score(question: pd.Series, text: pd.Series) -> pd.Series:
            return scorer(question, text).astype("float64")

        logit = score("question", "text")
    scored = hits.withColumn("score", F.round(rerank_score(logit), 6))
    return threshold_top_k(scored, ["query_id"], "score", "doc_id", k, threshold)


def embed(df: DataFrame, key: str, text: str, embedder: Embedder | None = None, dim: int = 64) -> DataFrame:
    """(key, embedding): ``embedder(texts) -> vectors``, or signed feature hashing."""
    if embedder is None:
        return V.hash_embed(df, key, F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)), dim)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield embedder(s)

    return df.select(key, vectors(text).alias("embedding"))


def evaluate_retriever(queries: DataFrame, truth: DataFrame, retriever: Callable[[DataFrame], DataFrame], k: int, item: str) -> DataFrame:
    """Score a lazily composed retriever (queries -> ranked rows)."""
    from leafmill.operators.evaluation import retrieval_metrics

    return retrieval_metrics(retriever(queries), truth, k, item)


@F.udtf(returnType="chunk_index int, chunk string")
class SplitText:
    """Table function ``text, size, overlap -> (chunk_index, chunk)`` for SQL callers."""

    def eval(self, text: str, size: int, overlap: int):
        for i, piece in enumerate(split_recursive(text or "", size, overlap)):
            yield i, piece


def extract_json(df: DataFrame, key: str, text: str, extractor: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """(key, json) from ``extractor(texts) -> JSON texts``; fences are removed, rows stay in their partition."""
    types = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "json": extractor(pdf[text])})

    out = df.select(key, text).mapInPandas(run, f"{key} {types[key]}, json string")
    return out.withColumn("json", X.lenient_json(F.col("json")))
