"""Retrieval, transcription, answer-quality and dataset measures."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql import types as T

from leafmill.functions import text as X
from leafmill.operators.aggregates import tidy
from leafmill.operators.joins import broadcast_if_small, is_small
from leafmill.operators.ranking import top_k_per_key
from leafmill.operators.running import running


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int, item: str) -> DataFrame:
    """Per query: P@k, R@k, reciprocal rank over the whole list, hit@k, mean rank of relevant hits.

    ranked(query_id, item, rank), relevant(query_id, item). Nothing relevant counts as full recall.
    """
    rel = relevant.select("query_id", item).distinct().withColumn("_rel", F.lit(1))
    hit = ranked.select("query_id", item, "rank").join(rel, ["query_id", item], "left")
    r = F.when(F.col("_rel") == 1, F.col("rank"))
    per = hit.groupBy("query_id").agg(
        F.count("*").alias("n_retrieved"),
        F.count_if((F.col("_rel") == 1) & (F.col("rank") <= k)).alias("hits"),
        F.min(r).alias("first"),
        F.avg(r).alias("mean_rank"),
    )
    total = rel.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    j = per.join(total, "query_id", "left").na.fill(0, ["n_relevant"])
    return j.select(
        "query_id",
        (F.col("hits") / F.least(F.lit(k), F.col("n_retrieved"))).alias("precision"),
        F.when(F.col("n_relevant") == 0, 1.0).otherwise(F.col("hits") / F.col("n_relevant")).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        (F.col("hits") > 0).alias("hit"),
        "mean_rank",
    )


def retrieval_suite(per_query: DataFrame, min_n: int = 10) -> DataFrame:
    return per_query.agg(
        F.count("*").alias("n_queries"),
        F.round(F.avg("precision"), 6).alias("mean_precision"),
        F.round(F.avg("recall"), 6).alias("mean_recall"),
        F.round(F.avg("reciprocal_rank"), 6).alias("mrr"),
        F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"),
        (F.count("*") >= min_n).alias("statistically_valid"),
    )


def bootstrap_ci(
    df: DataFrame, keys: list[str], value: str, replicates: int = 1000, min_n: int = 5, digits: int = 4, seed: int = 7
) -> DataFrame:
    """Mean, std and 95 % bootstrap interval per group.

    Values in [0, 1] are counted at ``digits`` decimals first, so a resample is one multinomial draw over at
    most ``10**digits + 1`` counts, whatever the number of rows; replicates are spread over 20 groups each.
    """
    n_parts, per = 20, replicates // 20
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, F.round(value, digits).alias("_v")).agg(F.count("*").alias("_n"))
    v, n = F.col("_v"), F.col("_n")
    moments = hist.groupBy(*keys).agg(
        F.sum(n).alias("n"), (F.sum(v * n) / F.sum(n)).alias("_mean"), (F.sum(v * v * n) / F.sum(n)).alias("_sq")
    )
    base = moments.select(
        *keys, "n", F.round("_mean", 4).alias("mean"),
        F.sqrt(F.greatest(F.col("_sq") - F.col("_mean") * F.col("_mean"), F.lit(0.0))).alias("_std"),
    )
    types = dict(hist.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", m double"

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        counts, values = pdf["_n"].to_numpy("int64"), pdf["_v"].to_numpy("float64")
        order = np.argsort(values)
        counts, values, total = counts[order], values[order], counts.sum()
        rng = np.random.default_rng([seed, int(pdf["_part"].iloc[0])])
        means = rng.multinomial(total, counts / total, size=per) @ values / total
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * per for k in keys}, "m": means})

    reps = (
        hist.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
        .groupBy(*keys, "_part")
        .applyInPandas(draw, schema)
    )
    ci = reps.groupBy(*keys).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("_ci"))
    ok = (F.col("n") >= min_n) & (F.col("_std") > 1e-10)
    return base.join(ci, keys).select(
        *keys,
        "n",
        "mean",
        F.round("_std", 4).alias("std"),
        (F.col("n") >= min_n).alias("statistically_valid"),
        F.when(ok, F.round(F.get("_ci", F.lit(0)), 4)).alias("ci_95_lower"),
        F.when(ok, F.round(F.get("_ci", F.lit(1)), 4)).alias("ci_95_upper"),
    )


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance by bit vectors: one column of the table is a few whole-number operations on ``len(a)`` bits."""
    m = len(a)
    if not a or not b:
        return m or len(b)
    codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), "<u4")
    places = {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes)}
    full, top = (1 << m) - 1, m - 1
    up, down, score = full, 0, m
    for ch in b:
        eq = places.get(ch, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        right = down | (((xh | up) & full) ^ full)
        left = up & xh
        score += (right >> top & 1) - (left >> top & 1)
        right = (right << 1 | 1) & full
        up = (left << 1 & full) | ((xv | right) ^ full)
        down = right & xv
    return score


@F.pandas_udf(T.IntegerType())
def _far_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else edit_distance(x, y) for x, y in zip(a, b)], dtype="Int32")


def with_distance(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Exact edit distance of two texts: a narrow band first, as most readings are close; bit vectors where it is passed."""
    near = F.call_function("levenshtein", F.col(a), F.col(b), F.lit(64))
    near = F.when(F.col(a) == "", F.length(F.col(b))).when(F.col(b) == "", F.length(F.col(a))).otherwise(near)
    far = [F.when(F.col("_near") < 0, F.col(c)) for c in (a, b)]
    return df.withColumn("_near", near).withColumn(out, F.coalesce(_far_distance(*far), "_near")).drop("_near")


def with_cer(df: DataFrame, pred: str, truth: str, out: str = "cer") -> DataFrame:
    """Character error rate of normalised texts, of any length."""
    n = df.withColumns({"_p": X.normalise_text(F.col(pred)), "_g": X.normalise_text(F.col(truth))})
    n = with_distance(n, "_p", "_g", "_d")
    p, g = F.col("_p"), F.col("_g")
    value = (
        F.when(F.col(pred).isNull() | F.col(truth).isNull(), 1.0)
        .when(F.length(g) == 0, F.when(F.length(p) == 0, 0.0).otherwise(1.0))
        .otherwise(F.least(F.lit(1.0), F.col("_d") / F.length(g)))
    )
    return n.withColumn(out, value).drop("_p", "_g", "_d")


#: The first four-byte character and how many there are: one letter per distinct word of a pair.
_FIRST_LETTER, _LETTERS = 0x10000, 0x100000


@F.pandas_udf(StructType([StructField("p", StringType()), StructField("g", StringType())]))
def _spelled(pred: pd.Series, truth: pd.Series) -> pd.DataFrame:
    """Both word lists as strings of one letter a word, numbered by first appearance; linear in the words."""
    ps, gs = [], []
    for p, g in zip(pred, truth):
        letters: dict[str, str] = {}
        for words, out in ((g, gs), (p, ps)):
            if words is None:
                out.append(None)
                continue
            out.append("".join(letters.setdefault(w, chr(_FIRST_LETTER + min(len(letters), _LETTERS - 1))) for w in words))
        if len(letters) > _LETTERS:
            raise ValueError(f"a pair has more than {_LETTERS:,} distinct words")
    return pd.DataFrame({"p": ps, "g": gs})


def with_wer(df: DataFrame, pred: str, truth: str, out: str = "wer") -> DataFrame:
    """Word error rate: a pair's distinct words become single characters, then the distance of texts applies."""
    n = df.withColumns(
        {"_p": X.split_space(X.normalise_text(F.col(pred))), "_g": X.split_space(X.normalise_text(F.col(truth)))}
    ).withColumn("_s", _spelled("_p", "_g"))
    n = with_distance(n.withColumns({"_sp": F.col("_s.p"), "_sg": F.col("_s.g")}), "_sp", "_sg", "_d")
    value = (
        F.when(F.col(pred).isNull() | F.col(truth).isNull(), 1.0)
        .when(F.size("_g") == 0, F.when(F.size("_p") == 0, 0.0).otherwise(1.0))
        .otherwise(F.least(F.lit(1.0), F.col("_d") / F.size("_g")))
    )
    return n.withColumn(out, value).drop("_p", "_g", "_s", "_sp", "_sg", "_d")


def f1(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)}


_COUNTS = StructType([StructField("n", T.IntegerType()), *[StructField(c, T.LongType()) for c in ("matched", "n_hyp", "n_ref")]])


@F.pandas_udf(T.ArrayType(_COUNTS))
def _gram_counts(hyp: pd.Series, ref: pd.Series, max_n: pd.Series) -> pd.Series:
    """Of two token arrays: clipped matches and grams of each length that either of them has."""

    def counts(a, b, most: int) -> list[tuple]:
        a, b = [] if a is None else list(a), [] if b is None else list(b)
        out = []
        for n in range(1, min(most, max(len(a), len(b))) + 1):
            x, y = (Counter(zip(*(t[i:] for i in range(n)))) for t in (a, b))
            few, many = sorted((x, y), key=len)
            out.append((n, sum(min(c, many[g]) for g, c in few.items() if g in many), max(len(a) - n + 1, 0), max(len(b) - n + 1, 0)))
        return out

    return pd.Series([counts(*row) for row in zip(hyp, ref, max_n)])


def ngram_overlap(pairs: DataFrame, key: list[str], hyp: Column, ref: Column, max_n: int = 4) -> DataFrame:
    """Clipped n-gram matches per pair and n. A pair's grams are counted in its row; only the rows of a key that comes
    more than once are spelled out, as their grams count together."""

    def gram(n: int):
        return lambda i: F.array_join(F.slice("_t", i, n), " ")

    def grams(rows: DataFrame, tokens: Column, side: str) -> DataFrame:
        both = None
        toks = rows.select(*key, tokens.alias("_t"))
        for n in range(1, max_n + 1):
            g = F.transform(F.sequence(F.lit(1), F.size("_t") - (n - 1)), gram(n))
            d = toks.where(F.size("_t") >= n).select(*key, F.lit(n).alias("n"), F.explode(g).alias("gram"))
            both = d if both is None else both.unionByName(d)
        return both.withColumns({"_h": F.lit(int(side == "h")), "_r": F.lit(int(side == "r"))})

    counted = pairs.withColumn("_rows", F.count("*").over(W.partitionBy(*key)))
    alone = counted.where("_rows = 1").select(*key, F.inline(_gram_counts(hyp, ref, F.lit(max_n))))
    repeated = counted.where("_rows > 1")
    per_gram = grams(repeated, hyp, "h").unionByName(grams(repeated, ref, "r")).groupBy(*key, "n", "gram").agg(
        F.sum("_h").alias("_h"), F.sum("_r").alias("_r")
    )
    return alone.unionByName(per_gram.groupBy(*key, "n").agg(
        F.sum(F.least("_h", "_r")).alias("matched"), F.sum("_h").alias("n_hyp"), F.sum("_r").alias("n_ref")
    ))


def bleu_rouge1(overlap: DataFrame, key: list[str]) -> DataFrame:
    """bleu_1, bleu_4 and rouge_1 per pair in one pass. Smoothing: 0.1 for a zero unigram count, halving steps for higher orders."""
    at = lambda c, n: F.max(F.when(F.col("n") == n, F.col(c)))
    w = overlap.groupBy(*key).agg(
        *[F.coalesce(at("matched", n), F.lit(0)).alias(f"_m{n}") for n in range(1, 5)],
        *[F.greatest(F.coalesce(at("n_hyp", n), F.lit(0)), F.lit(1)).alias(f"_d{n}") for n in range(1, 5)],
        F.coalesce(at("n_hyp", 1), F.lit(0)).alias("_hyp"),
        F.coalesce(at("n_ref", 1), F.lit(0)).alias("_ref"),
    )
    bp = F.when(F.col("_hyp") > F.col("_ref"), 1.0).when(F.col("_hyp") == 0, 0.0).otherwise(
        F.exp(1 - F.col("_ref") / F.col("_hyp"))
    )
    logs, zeros = F.lit(0.0), F.lit(0)
    for n in range(1, 5):
        m, d = F.col(f"_m{n}"), F.col(f"_d{n}")
        zeros = zeros + (m == 0).cast("int")
        logs = logs + 0.25 * F.log(F.when(m > 0, m / d).otherwise(1 / (F.pow(F.lit(2.0), zeros) * d)))
    one = F.when(F.col("_m1") > 0, F.col("_m1") / F.col("_d1")).otherwise(0.0)
    return w.select(
        *key,
        (bp * one).alias("bleu_1"),
        F.when(F.col("_m1") > 0, bp * F.exp(logs)).otherwise(0.0).alias("bleu_4"),
        F.when(F.col("_m1") > 0, 2.0 * F.col("_m1") / (F.col("_hyp") + F.col("_ref"))).otherwise(0.0).alias("rouge_1"),
    )


def bleu(overlap: DataFrame, key: list[str]) -> DataFrame:
    return bleu_rouge1(overlap, key).drop("rouge_1")


def rouge1(overlap: DataFrame, key: list[str]) -> DataFrame:
    p, r = F.col("matched") / F.col("n_hyp"), F.col("matched") / F.col("n_ref")
    return overlap.where("n = 1").select(*key, F.when(F.col("matched") > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("rouge_1"))


@F.pandas_udf(T.DoubleType())
def rouge_l(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """F-measure of the longest common subsequence of two token arrays."""

    def score(a, b) -> float:
        if not len(a) or not len(b):
            return 0.0
        ids = {w: i for i, w in enumerate(set(a) | set(b))}
        x, y = np.array([ids[w] for w in a]), np.array([ids[w] for w in b])
        row = np.zeros(len(y) + 1, dtype="int64")
        for w in x:
            step = np.maximum(row[1:], row[:-1] + (y == w))
            row[1:] = np.maximum.accumulate(step)
        lcs = row[-1]
        p, r = lcs / len(a), lcs / len(b)
        return 2 * p * r / (p + r) if lcs else 0.0

    for a, b in batches:
        yield pd.Series([score(x, y) for x, y in zip(a, b)], dtype="float64")


# Composite weights and alert thresholds.
RAG_WEIGHTS = {"faithfulness": 0.35, "answer_relevancy": 0.25, "context_precision": 0.25, "context_recall": 0.15}
ALERT_LEVELS = {
    "faithfulness": (0.75, 0.60),
    "answer_relevancy": (0.65, 0.50),
    "context_precision": (0.60, 0.45),
    "context_recall": (0.55, 0.40),
}
GATE = {"faithfulness": 0.60, "answer_relevancy": 0.55, "context_precision": 0.50, "composite": 0.55}


def rag_composite() -> Column:
    return sum((F.col(m) * w for m, w in RAG_WEIGHTS.items()), F.lit(0.0))


def rag_report(samples: DataFrame, keys: list[str]) -> DataFrame:
    failing = F.count_if(F.col("faithfulness") < 0.75)
    return samples.groupBy(*keys).agg(
        F.count("*").alias("n_samples"),
        *[F.round(F.avg(m), 4).alias(f"mean_{m}") for m in RAG_WEIGHTS],
        F.round(F.avg(rag_composite()), 4).alias("mean_composite"),
        failing.alias("failing_count"),
        F.round(failing / F.count("*"), 4).alias("failing_ratio"),
        (F.avg("faithfulness") < 0.75).alias("faithfulness_alert"),
    )


def claim_scores(verdicts: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """Share of supported claims per sample: no claims 1.0, no answer or context 0.0."""
    v = verdicts.groupBy(key).agg(F.count("*").alias("_n"), F.count_if("supported").alias("_s"))
    j = samples.select(key, "has_inputs").join(v, key, "left")
    share = F.when(F.coalesce("_n", F.lit(0)) == 0, 1.0).otherwise(F.least(F.col("_s") / F.col("_n"), F.lit(1.0)))
    return j.select(key, F.coalesce("_n", F.lit(0)).alias("n_claims"), F.when(F.col("has_inputs"), share).otherwise(0.0).alias("faithfulness"))


def _long(metrics: DataFrame, keys: list[str], levels: dict[str, tuple]) -> DataFrame:
    rows = [
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), *[F.lit(x).alias(f"l{i}") for i, x in enumerate(ls)])
        for m, ls in levels.items()
    ]
    return metrics.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


def threshold_alerts(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Critical before warning; a missing metric raises nothing."""
    v = F.col("value")
    out = _long(metrics, keys, ALERT_LEVELS).where(v < F.greatest("l0", "l1"))
    return out.select(
        *keys,
        "metric",
        tidy(v, 4).alias("value"),
        F.when(v < F.col("l1"), "critical").otherwise("warning").alias("severity"),
        F.when(v < F.col("l1"), F.col("l1")).otherwise(F.col("l0")).alias("threshold"),
    )


def quality_gate(metrics: DataFrame, keys: list[str]) -> DataFrame:
    long = _long(metrics, keys, {m: (g,) for m, g in GATE.items()}).withColumnRenamed("l0", "threshold")
    return long.withColumn("passed", F.col("value") >= F.col("threshold"))


def mean_available(*cols: Column) -> Column:
    have = F.array_compact(F.array(*cols))
    return F.when(F.size(have) > 0, F.round(F.aggregate(have, F.lit(0.0), lambda a, x: a + x) / F.size(have), 6)).otherwise(0.0)


def triplets(chunks: DataFrame, n_candidates: int = 5) -> DataFrame:
    """(chunk, positive, negative): candidates are other texts of the same source in order, then other sources.

    The first n chunks that differ from a given text are always among the first 2n of a list that holds each
    text at most n times; the first n chunks of other sources likewise. So every chunk meets at most 2n rows
    of its source, which come as one list, and 2n global ones; no pairs of a source are spelled out.
    """
    n = n_candidates
    usable = chunks.where(F.length("text") > 30).withColumn("_o", -F.col("seq"))
    few = top_k_per_key(usable, ["source", "text"], "_o", "seq", n, "_r")
    same = top_k_per_key(few, ["source"], "_o", "seq", 2 * n, "_r").select("source", F.col("seq").alias("q"), F.col("text").alias("t"))
    heads = top_k_per_key(usable, ["source"], "_o", "seq", n, "_r").orderBy("seq").limit(2 * n)
    cross = heads.groupBy().agg(F.array_sort(F.collect_list(F.struct("seq", "source", "text"))).alias("c")).scalar()
    anchors = chunks.where(F.length(X.strip(F.col("text"))) > 50).select("source", "seq", "text")
    lists = same.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("q", "t"))).alias("near"))
    mine = F.filter("near", lambda x: x["t"] != F.col("text"))
    full = anchors.join(lists, "source", "left").withColumn("s", mine).withColumn("c", cross)
    others = F.transform(
        F.filter("c", lambda x: x["source"] != F.col("source")), lambda x: F.struct(x["seq"].alias("q"), x["text"].alias("t"))
    )
    listed = full.withColumn("cand", F.slice(F.when(F.col("s").isNull(), others).otherwise(F.concat("s", others)), 1, n))
    pick = F.get("cand", F.pmod(F.col("seq"), F.greatest(F.size("cand"), F.lit(1))).cast("int"))
    return listed.select(
        "source", "seq", F.col("text").alias("positive"), F.size("cand").alias("n_candidates"),
        pick["q"].alias("negative_seq"), pick["t"].alias("negative"),
    )


def train_val_split(df: DataFrame, key: str, ratio: float = 0.1, seed: str = "42") -> DataFrame:
    """``split`` column: the max(1, int(n * ratio)) smallest seeded hashes are validation rows."""
    h = df.withColumn("_h", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed))))
    ranked = running(h, [], [F.col("_h"), F.col(key)], F.substring("_h", 1, 3), {"_r": ("sum", F.lit(1))})
    n = df.select(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(ratio)))).scalar()
    return ranked.withColumn("split", F.when(F.col("_r") <= n, "val").otherwise("train")).drop("_h", "_r")


def containing_documents(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id) of documents that contain the passage.

    The passage's rarest inner word finds the candidates (its edge words may be cut words in the document); passages
    of up to two words have no inner word and are found by their first characters. ``contains`` then decides. Empty
    passages find nothing.
    """
    toks = X.tokenize_words(F.col("text"))
    inner = F.slice(toks, 2, F.size(toks) - 2)
    long_ = passages.where(F.size(toks) > 2)
    short = passages.where((F.size(toks) <= 2) & (F.length("text") > 0))
    by_word = _containing_by_word(long_, docs, toks, inner)
    if short.isEmpty():
        return by_word
    return by_word.unionByName(_containing_by_start(short, docs))


def _containing_by_start(passages: DataFrame, docs: DataFrame, n: int = 3) -> DataFrame:
    """Candidates share the passage's first ``n`` characters (all, if it has fewer)."""
    q = passages.select("query_id", F.col("text").alias("passage"), F.substring("text", 1, n).alias("gram"))
    lengths = F.array(*[F.lit(k) for k in range(1, n + 1)])
    places = F.sequence(F.lit(1), F.length("text"))
    grams = F.transform(lengths, lambda k: F.transform(places, lambda i: F.substring(F.col("text"), i, k)))
    found = docs.where(F.length("text") > 0).select("doc_id", F.explode(F.array_distinct(F.flatten(grams))).alias("gram"))
    cand = found.join(broadcast_if_small(q, 100_000), "gram").select("query_id", "passage", "doc_id")
    inside = cand.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("passage")))
    return inside.select("query_id", "doc_id")


def _containing_by_word(passages: DataFrame, docs: DataFrame, toks: Column, inner: Column) -> DataFrame:
    q = passages.select("query_id", F.col("text").alias("passage"), F.explode(F.array_distinct(inner)).alias("term"))
    asked = broadcast_if_small(q.select("term").distinct())
    every = docs.select("doc_id", F.explode(F.array_distinct(toks)).alias("term"))
    words = every.join(asked, "term", "left_semi")
    df = words.groupBy("term").agg(F.count("*").alias("df"))
    anchor = (
        q.join(df, "term")
        .groupBy("query_id", "passage")
        .agg(F.min(F.struct("df", "term")).alias("a"))
        .select("query_id", "passage", F.col("a.term").alias("term"))
    )
    # One row per passage at most: the passages bound the side, so its own plan need not run to be counted.
    small = is_small(passages, 100_000)
    cand = every.join(F.broadcast(anchor) if small else anchor, "term").select("query_id", "passage", "doc_id")
    return (
        cand.join(docs.select("doc_id", "text"), "doc_id")
        .where(F.contains("text", F.col("passage")))
        .select("query_id", "doc_id")
    )
