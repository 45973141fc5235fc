"""Comparison of the documents of a job (2 to 50 of them): shared terms, differences, sentences that sum them up.

Jobs with fewer documents or more yield nothing. A job of at most ``JOB_CHARS`` characters is compared in the task that
its texts move to, once. In longer jobs documents meet through terms by joins, sentences through terms only, so no pair
of sentences is ever formed. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators.joins import broadcast_if_small
from leafmill.operators.ranking import top_k_per_key
from leafmill.sources.scratch import written

MIN_DOCS, MAX_DOCS = 2, 50
#: Characters of all texts of a job that one task compares at once.
JOB_CHARS = 16 << 20
#: Terms whose weights are held as a matrix at once.
_COLUMNS = 4096


def comparable(docs: DataFrame, job: str, doc: str, text: str, job_chars: int) -> tuple[DataFrame, DataFrame | None]:
    """``(job, doc, text, n)`` of jobs that may be compared: those of at most ``job_chars`` characters, and longer ones if any.

    ``n`` is the job's number of documents. The rows of the former lie by job.
    """
    rows = docs.select(F.col(job).alias("job"), F.col(doc).alias("doc"), F.col(text).alias("text"))
    sizes = rows.groupBy("job").agg(F.count_distinct("doc").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    sizes = written(sizes.where(F.col("n").between(MIN_DOCS, MAX_DOCS)), "sizes")
    small = rows.join(broadcast_if_small(sizes.where(F.col("chars") <= job_chars).drop("chars")), "job").repartition("job")
    long = sizes.where(F.col("chars") > job_chars).drop("chars")
    return small, None if long.isEmpty() else rows.join(long, "job")


def _by_job(small: DataFrame, words: Column, fields: str, compare: Callable[..., dict[str, list]], *more: Column) -> DataFrame:
    """Rows of ``compare(docs, n, place, term, terms, *more)`` for each job.

    ``words`` is an array of words; the i-th word of all the job's rows is ``terms[term[i]]`` and stands in row ``place[i]``.
    """
    kinds = {f: small.schema[f].dataType.simpleString() for f in ("job", "doc")}
    names = ["job", "doc", "n", "words", *(f"more{i}" for i in range(len(more)))]
    cols = [words.alias("words"), *(c.alias(f"more{i}") for i, c in enumerate(more))]

    def run(rows: pa.Table) -> pa.Table:
        got = {c: rows[c].combine_chunks() for c in names}
        held = got["words"].flatten().dictionary_encode()
        place = np.repeat(np.arange(len(rows)), got["words"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        out = compare(
            got["doc"].to_pylist(), got["n"][0].as_py(), place, held.indices.to_numpy(zero_copy_only=False).astype(np.int64),
            held.dictionary, *(got[c] for c in names[4:])
        )
        size = len(next(iter(out.values())))
        job = got["job"].take(pa.array(np.zeros(size, np.int64)))
        keys = {c: pa.array(v, got["doc"].type) for c, v in out.items() if c.startswith("doc")}
        return pa.table({"job": job, **out, **keys})

    return small.select("job", "doc", "n", *cols).groupBy("job").applyInArrow(run, f"job {kinds['job']}, {fields.format(**kinds)}")


def _weights(docs: list, n: int, place: np.ndarray, term: np.ndarray, size: int) -> tuple[list, np.ndarray, ...]:
    """Distinct documents and, for each of their distinct terms: document, term, ``tf``, ``df`` and weight."""
    names = sorted(set(docs))
    at = {d: i for i, d in enumerate(names)}
    rows = np.array([at[d] for d in docs], np.int64)[place]
    key, tf = np.unique(rows * max(size, 1) + term, return_counts=True)
    row, column = np.divmod(key, max(size, 1))
    df = np.bincount(column, minlength=size)[column]
    return names, row, column, tf, df, tf * (np.log((n + 1) / (df + 1)) + 1)


def term_weights(docs: DataFrame) -> DataFrame:
    """``(job, doc, term, tf, df, n, w)``: tf-idf within the job, ``w = tf * (ln((1 + n) / (1 + df)) + 1)``."""
    tf = docs.select("job", "doc", "n", F.explode(X.tokenize_words(F.col("text"))).alias("term"))
    tf = tf.groupBy("job", "doc", "n", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("job", "term").agg(F.count("*").alias("df"))
    w = F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)
    return tf.join(df, ["job", "term"]).select("job", "doc", "term", "tf", "df", "n", w.alias("w"))


def similarity(docs: DataFrame, job: str, doc: str, text: str, job_chars: int = JOB_CHARS) -> DataFrame:
    """``(job, doc_a, doc_b, n_shared, score)``: pairs of a job with common terms; score 0 to 100 is their tf-idf cosine."""
    small, long = comparable(docs, job, doc, text, job_chars)

    def compare(docs: list, n: int, place: np.ndarray, term: np.ndarray, terms: pa.Array) -> dict[str, list]:
        names, row, column, _, df, w = _weights(docs, n, place, term, len(terms))
        unit = w / np.sqrt(np.bincount(row, w * w, len(names)))[row]
        kept = np.flatnonzero(df > 1)
        kept = kept[np.argsort(column[kept], kind="stable")]
        row, unit, column = row[kept], unit[kept], np.unique(column[kept], return_inverse=True)[1]
        shared, dot = np.zeros((2, len(names), len(names)))
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
            part = slice(*np.searchsorted(column, [first, first + _COLUMNS]))
            held = np.zeros((2, len(names), _COLUMNS))
            held[:, row[part], column[part] - first] = np.ones(len(row[part])), unit[part]
            shared, dot = shared + held[0] @ held[0].T, dot + held[1] @ held[1].T
        a, b = np.nonzero(np.triu(shared, 1))
        return {
            "doc_a": [names[i] for i in a], "doc_b": [names[i] for i in b], "n_shared": shared[a, b].astype(np.int64), "score": 100 * dot[a, b],
        }

    met = _by_job(small, X.tokenize_words(F.col("text")), "doc_a {doc}, doc_b {doc}, n_shared long, score double", compare)
    met = met.withColumn("score", F.round("score", 2))
    return met if long is None else met.unionByName(_long_similarity(long))


def _long_similarity(docs: DataFrame) -> DataFrame:
    w = written(term_weights(docs), "weights")
    norms = w.groupBy("job", "doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = w.where("df > 1").join(norms, ["job", "doc"]).select("job", "doc", "term", (F.col("w") / F.col("norm")).alias("u"))
    a = unit.select("job", "term", F.col("doc").alias("doc_a"), F.col("u").alias("_a"))
    b = unit.select("job", "term", F.col("doc").alias("doc_b"), F.col("u").alias("_b"))
    met = a.join(b, ["job", "term"]).where("doc_a < doc_b").groupBy("job", "doc_a", "doc_b")
    return met.agg(F.count("*").alias("n_shared"), F.round(100 * F.sum(F.col("_a") * F.col("_b")), 2).alias("score"))


def difference(docs: DataFrame, job: str, doc: str, text: str, k: int = 5, job_chars: int = JOB_CHARS) -> DataFrame:
    """``(job, doc, n_own, share, terms)``: terms that only this document of its job has, the ``k`` heaviest named.

    ``share`` is their part of the document's weight, rounded to four decimals; equal weights go by term.
    """
    small, long = comparable(docs, job, doc, text, job_chars)

    def compare(docs: list, n: int, place: np.ndarray, term: np.ndarray, terms: pa.Array) -> dict[str, list]:
        names, row, column, tf, df, w = _weights(docs, n, place, term, len(terms))
        own = df == 1
        n_own, part, whole = (np.bincount(row, x, len(names)) for x in (own, np.where(own, w, 0.0), w))
        seen, first = np.unique(row, return_index=True)
        named = []
        for s, e in zip(first, [*first[1:], len(row)]):
            mine = s + np.flatnonzero(own[s:e])
            if len(mine) > k:  # a document's own terms weigh as often as they occur
                mine = mine[tf[mine] >= np.partition(tf[mine], len(mine) - k)[len(mine) - k]]
            best = sorted(zip((-tf[mine]).tolist(), (t.encode() for t in terms.take(pa.array(column[mine])).to_pylist())))[:k]
            named.append(" ".join(t.decode() for _, t in best))
        return {"doc": [names[i] for i in seen], "n_own": n_own[seen].astype(np.int64), "share": part[seen] / whole[seen], "terms": pa.array(named, pa.string())}

    told = _by_job(small, X.tokenize_words(F.col("text")), "doc {doc}, n_own long, share double, terms string", compare)
    told = told.withColumn("share", F.round("share", 4))
    return told if long is None else told.unionByName(_long_difference(long, k))


def _long_difference(docs: DataFrame, k: int) -> DataFrame:
    w = written(term_weights(docs), "weights").withColumn("w6", F.round("w", 6))
    own = F.col("df") == 1
    sums = w.groupBy("job", "doc").agg(
        F.count_if(own).alias("n_own"), F.round(F.sum(F.when(own, F.col("w")).otherwise(0.0)) / F.sum("w"), 4).alias("share")
    )
    top = top_k_per_key(w.where(own), ["job", "doc"], "w6", "term", k)
    named = top.groupBy("job", "doc").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]), " ").alias("terms")
    )
    return sums.join(named, ["job", "doc"], "left").na.fill("", ["terms"])


def summary(
    docs: DataFrame, job: str, doc: str, text: str, k: int = 3, rounds: int = 8, damping: float = 0.85, job_chars: int = JOB_CHARS
) -> DataFrame:
    """``(job, rank, doc, at, sentence, score)``: the ``k`` sentences of a job that a walk over common terms visits most.

    The walk goes from a sentence to one of its distinct terms and from there to a sentence that has it, or, with
    ``1 - damping``, to any sentence of the job. ``rounds`` steps are taken from equal chances; scores are rounded to nine
    decimals, ties go by document and place. Sentences without terms are never visited by way of terms.
    """
    small, long = comparable(docs, job, doc, text, job_chars)

    def compare(docs: list, n: int, place: np.ndarray, term: np.ndarray, terms: pa.Array, at: pa.Array, said: pa.Array) -> dict[str, list]:
        # a sentence's distinct words, one vertex for each of them and of the sentences
        s, t = np.divmod(np.unique(place * max(len(terms), 1) + term), max(len(terms), 1))
        n_s, n_t = np.bincount(s, minlength=len(docs)), np.bincount(t, minlength=len(terms))
        r = np.full(len(docs), 1 / len(docs))
        for _ in range(rounds):
            sent = np.bincount(t, (r / np.maximum(n_s, 1))[s], len(terms))
            r = (1 - damping) / len(docs) + damping * np.bincount(s, (sent / np.maximum(n_t, 1))[t], len(docs))
        score, places = np.round(r, 9), at.to_pylist()
        best = sorted(range(len(docs)), key=lambda i: (-score[i], docs[i], places[i]))[:k]
        return {
            "rank": pa.array(range(1, len(best) + 1), pa.int32()), "doc": [docs[i] for i in best], "at": pa.array([places[i] for i in best], pa.int32()),
            "sentence": said.take(pa.array(best, pa.int64())), "score": score[best],
        }

    cut = small.select("job", "doc", "n", F.posexplode(X.sentences(F.col("text"))).alias("at", "sentence"))
    fields = "rank int, doc {doc}, at int, sentence string, score double"
    best = _by_job(cut, X.tokenize_words(F.col("sentence")), fields, compare, F.col("at"), F.col("sentence"))
    return best if long is None else best.unionByName(_long_summary(long, k, rounds, damping))


def _long_summary(docs: DataFrame, k: int, rounds: int, damping: float) -> DataFrame:
    rows = docs.select("job", "doc", F.posexplode(X.sentences(F.col("text"))).alias("at", "sentence"))
    rows = written(rows.withColumn("id", F.struct("doc", "at")), "sentences")
    links = rows.select("job", "id", F.explode(F.array_distinct(X.tokenize_words(F.col("sentence")))).alias("term"))
    out_s = links.groupBy("job", "id").agg(F.count("*").alias("n_s"))
    out_t = links.groupBy("job", "term").agg(F.count("*").alias("n_t"))
    links = written(links.join(out_s, ["job", "id"]).join(out_t, ["job", "term"]), "links")
    sizes = written(rows.groupBy("job").agg(F.count("*").alias("n")), "sizes")
    start = written(rows.select("job", "id").join(sizes, "job").select("job", "id", "n", (1 / F.col("n")).alias("r")), "ranks")
    ranks = start
    for _ in range(rounds):
        sent = links.join(ranks.select("job", "id", "r"), ["job", "id"]).groupBy("job", "term").agg(F.sum(F.col("r") / F.col("n_s")).alias("r"))
        back = links.select("job", "term", "id", "n_t").join(sent, ["job", "term"]).groupBy("job", "id").agg(
            F.sum(F.col("r") / F.col("n_t")).alias("got")
        )
        r = (1 - damping) / F.col("n") + damping * F.coalesce("got", F.lit(0.0))
        ranks = written(start.select("job", "id", "n").join(back, ["job", "id"], "left").select("job", "id", "n", r.alias("r")), "ranks")
    scored = ranks.select("job", "id", F.round("r", 9).alias("score"))
    top = top_k_per_key(scored, ["job"], "score", "id", k)
    return top.join(rows.select("job", "id", "sentence"), ["job", "id"]).select(
        "job", "rank", F.col("id.doc").alias("doc"), F.col("id.at").alias("at"), "sentence", "score"
    )
