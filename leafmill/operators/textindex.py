"""A stored search index: postings in blocks with score bounds, and vectors, in segments with a commit log.

Layout under one folder::

    postings/segment=S/part=P   (term, page, n, top, keys, tfs, dls), sorted by term and page
    documents/segment=S         (key, dl) of every document with a term
    vectors/segment=S           (key, embedding), if vectors are added
    log/                        one row per committed segment, with the segments that it replaces
    floor/                      the mean weight of all terms, per set of segments

A page is a bucket of documents, so a block holds one term's postings in at most some 64 documents and everything about
a document lies in blocks of one page. ``part`` is a bucket of terms: a search reads the parts of the asked terms and,
as files are sorted by term, only their row groups. A segment counts once its log row is there; adding a segment that
is in the log does nothing, and what a failed attempt left is overwritten.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators.ranking import top_k_per_key
from leafmill.operators.running import running
from leafmill.sources.scratch import stored_at, written

# Keyword ranking constants.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Documents of a page, buckets of terms, queries that are scored together.
PAGE_DOCS, PARTS, QUERY_BLOCK = 64, 32, 256
#: Bins of a doubling of the score, within which all hits of a query are ranked, and documents per further set of bins.
SCORE_BINS, BIN_DOCS = 8, 1 << 17

LOG = "segment string, n_docs long, n_pages long, sum_dl long, avgdl double, replaces array<string>, added timestamp"


def _saturation(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def page_blocks(docs: DataFrame, key: str, text: str, n_pages: int, avgdl: float) -> DataFrame:
    """``(term, page, n, top, keys, tfs, dls)`` of documents whose texts move to the task of their page, where all is counted."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text <> ''").withColumn("page", _page_of("key", n_pages))
    rows = rows.repartition("page").sortWithinPartitions("page", "key").select("page", "key", X.tokenize_words(F.col("text")).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, held, key_type = None, {}, None

        def blocks() -> pa.RecordBatch:
            n, flat = [len(x) for x in held.values()], [x for v in held.values() for x in v]
            keys, tfs, dls = (list(x) for x in zip(*flat))
            tf, dl = np.array(tfs, float), np.array(dls)
            ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            top = np.maximum.reduceat(tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl)), ends[:-1])
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x, t)) for x, t in ((keys, key_type), (tfs, pa.int32()), (dls, pa.int32()))]
            cols = [pa.array(list(held), pa.string()), pa.array([page] * len(n), pa.int32()), pa.array(n, pa.int32()), pa.array(top), *lists]
            return pa.RecordBatch.from_arrays(cols, ["term", "page", "n", "top", "keys", "tfs", "dls"])

        for b in batches:
            key_type = b.column(1).type
            for at, k, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if at != page and held:
                    yield blocks()
                    held = {}
                page, words = at, tokens.as_py()
                for term, tf in Counter(words).items():
                    held.setdefault(term, []).append((k, tf, len(words)))
        if held:
            yield blocks()

    return rows.mapInArrow(run, f"term string, page int, n int, top double, keys array<{kind}>, tfs array<int>, dls array<int>")


def _page_of(key: str, n_pages: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_pages)).cast("int")


class TextIndex:
    """A search index in ``path``, a folder that driver and executors share. Keys are unique over all segments."""

    def __init__(self, spark: SparkSession, path: str, key_type: str = "long"):
        self.spark, self.path, self.key_type = spark, path.rstrip("/"), key_type

    def table(self, name: str, columns: str, replaced: bool = False) -> DataFrame:
        """Rows of a table by segment; of committed segments only, and of ``replaced`` ones if these are still its home."""
        path, schema = f"{self.path}/{name}", f"{columns}, segment string"
        if not stored_at(self.spark, path):
            return self.spark.createDataFrame([], schema)
        names = [r.segment for r in self._commits().collect()] if replaced else self.segments()
        return self.spark.read.schema(schema).parquet(path).where(F.col("segment").isin(names))

    def _commits(self) -> DataFrame:
        path = f"{self.path}/log"
        return self.spark.read.schema(LOG).parquet(path) if stored_at(self.spark, path) else self.spark.createDataFrame([], LOG)

    def log(self) -> DataFrame:
        """Rows of the segments that count: committed and not replaced."""
        rows = self._commits()
        return rows.join(rows.select(F.explode("replaces").alias("segment")).distinct(), "segment", "left_anti")

    def segments(self) -> list[str]:
        """Names of the segments that count; compaction keeps them few."""
        return sorted(r.segment for r in self.log().select("segment").collect())

    def committed(self, segment: str) -> bool:
        """Whether a segment of this name was ever committed, replaced since or not."""
        return not self._commits().where(F.col("segment") == segment).isEmpty()

    def add(self, segment: str, docs: DataFrame, key: str = "doc_id", text: str = "text", vectors: DataFrame | None = None) -> bool:
        """Add the documents (and ``vectors(key, embedding)``) as one segment; False if that was done already.

        Null and token-free texts are left out. Names begin with a letter, so that no reader takes them for numbers.
        """
        if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", segment):
            raise ValueError(f"no name of a segment: {segment!r}")
        if self.committed(segment):
            return False
        lengths = docs.select(F.col(key).alias("key"), F.size(X.tokenize_words(F.col(text))).alias("dl")).where("dl > 0")
        self._write(segment, lengths, lambda n_pages, avgdl: page_blocks(docs, key, text, n_pages, avgdl), vectors, [])
        return True

    def compact(self, segment: str) -> bool:
        """All segments as one, under a new name. Readers see either the old ones or the new one."""
        old = self.segments()
        if self.committed(segment) or len(old) < 2:
            return False
        rows = self.postings().select("term", F.explode(F.arrays_zip("keys", "tfs", "dls")).alias("p"))
        counted = rows.select(F.col("p.keys").alias("key"), F.col("p.dls").alias("dl"), "term", F.col("p.tfs").alias("tf"))
        vectors = self.vectors() if stored_at(self.spark, f"{self.path}/vectors") else None
        counted = written(counted, "frequencies")

        def blocks(n_pages: int, avgdl: float) -> DataFrame:
            impact = _saturation(F.col("tf"), F.col("dl"), F.lit(avgdl))
            paged = counted.select("key", "dl", "term", "tf", _page_of("key", n_pages).alias("page"), impact.alias("impact"))
            grouped = paged.groupBy("term", "page").agg(
                F.count("*").cast("int").alias("n"), F.max("impact").alias("top"),
                F.array_sort(F.collect_list(F.struct("key", "tf", "dl"))).alias("p"),
            )
            return grouped.select("term", "page", "n", "top", *[F.col(f"p.{c}").alias(f"{c}s") for c in ("key", "tf", "dl")])

        self._write(segment, counted.groupBy("key").agg(F.max("dl").alias("dl")), blocks, vectors, old)
        return True

    def _write(
        self, segment: str, lengths: DataFrame, blocks: Callable[[int, float], DataFrame], vectors: DataFrame | None, replaces: list[str]
    ) -> None:
        """Blocks, lengths and vectors, then the log row that makes them count.

        Terms go to (part, group of pages), so a term that stands in every document is dealt to as many tasks as
        there are groups.
        """
        lengths.write.mode("overwrite").parquet(f"{self.path}/documents/segment={segment}")
        totals = self.spark.read.parquet(f"{self.path}/documents/segment={segment}")
        n_docs, sum_dl = totals.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        n_pages, avgdl = max(1, -(-n_docs // PAGE_DOCS)), sum_dl / n_docs if n_docs else 0.0
        part = F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")
        groups = max(1, n_pages // 4096)
        laid = blocks(n_pages, avgdl or 1.0).withColumns({"part": part, "_g": F.col("page") % groups})
        laid = laid.repartition("part", "_g").drop("_g").sortWithinPartitions("part", "term", "page")
        laid.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/postings/segment={segment}")
        if vectors is not None:
            vectors.select("key", "embedding").write.mode("overwrite").parquet(f"{self.path}/vectors/segment={segment}")
        row = self.spark.createDataFrame(
            [(segment, n_docs, n_pages, sum_dl, float(avgdl), replaces)],
            "segment string, n_docs long, n_pages long, sum_dl long, avgdl double, replaces array<string>",
        )
        row.withColumn("added", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def postings(self) -> DataFrame:
        lists = f"keys array<{self.key_type}>, tfs array<int>, dls array<int>"
        return self.table("postings", f"term string, page int, n int, top double, {lists}, part int")

    def documents(self) -> DataFrame:
        return self.table("documents", f"key {self.key_type}, dl int")

    def vectors(self) -> DataFrame:
        return self.table("vectors", f"key {self.key_type}, embedding array<double>").drop("segment")

    def totals(self) -> tuple[int, float]:
        """Documents and their mean length, from the log."""
        n, total = self.log().agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("sum_dl"), F.lit(0))).first()
        return n, total / n if n else 0.0

    def terms(self) -> DataFrame:
        """``(term, df)`` of all terms; reads two narrow columns of the blocks."""
        return self.postings().groupBy("term").agg(F.sum("n").alias("df"))

    def floor(self) -> float:
        """A share of the mean weight of all terms, which negative weights are raised to; kept per set of segments."""
        n, _ = self.totals()
        name = str(hash_of(self.segments()))
        path = f"{self.path}/floor/{name}"
        if not stored_at(self.spark, path):
            value = self.terms().agg(F.avg(raw_weight(n)) * EPSILON).first()[0]
            self.spark.createDataFrame([(value,)], "floor double").coalesce(1).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path).first()[0] or 0.0

    def search(
        self, queries: DataFrame, k: int | None, query_key: str = "query_id", text: str = "text", key: str = "doc_id",
        block: int = QUERY_BLOCK,
    ) -> DataFrame:
        """``(query_id, doc_id, score, rank)``: the best ``k`` documents of each query, scores above 0, ties by key.

        Without ``k`` these are all documents with a score above 0; a query's hits are then ranked in bins of scores.

        Queries are a stated set and come in blocks of ``block``; a block's terms and weights go to the tasks. Of the index
        only the asked terms' blocks move, to the task of their page, where a page is scored for all queries at once,
        unless its bounds say that no document of it reaches the k-th best score known there.
        """
        kind = queries.schema[query_key].dataType.simpleString()
        tokens = queries.select(F.col(query_key).alias("query"), F.explode(X.tokenize_words(F.col(text))).alias("term"))
        asked = written(tokens.groupBy("query", "term").agg(F.count("*").cast("int").alias("qtf")), "asked")
        blocks = -(-asked.agg(F.count_distinct("query")).first()[0] // block)
        log = {r.segment: r for r in self.log().collect()}
        n, total = sum(r.n_docs for r in log.values()), sum(r.sum_dl for r in log.values())
        out = self.spark.createDataFrame([], f"query {kind}, key {self.key_type}, score double")
        for i in range(blocks if n else 0):
            rows = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i).collect()
            if rows:
                out = out.unionByName(self._scored(rows, kind, k, n, total / n, log))
        named = out.withColumnsRenamed({"query": query_key, "key": key})
        if k is not None:
            return top_k_per_key(named, [query_key], "score", key, k)
        finer = SCORE_BINS * (1 + n // BIN_DOCS)
        bin_ = F.floor(-F.log2("score") * finer)
        held = written(named, "scores").withColumn("_query", F.struct(query_key))  # a null query meets itself
        ranked = running(held, ["_query"], [F.desc("score"), F.col(key)], bin_, {"rank": ("sum", F.lit(1))})
        return ranked.select(query_key, key, "score", F.col("rank").cast("int").alias("rank"))

    def _scored(self, rows: list, kind: str, k: int | None, n: int, avgdl: float, log: dict) -> DataFrame:
        """The best ``k`` of each task, or all hits, for a block of queries, given as ``(query, term, qtf)`` rows."""
        names = sorted({r.term for r in rows})
        place = {t: i for i, t in enumerate(names)}
        asked = self.spark.createDataFrame(list(place.items()), "term string, _t int")
        asked = F.broadcast(asked.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")))
        held = self.postings().join(asked, ["part", "term"])
        dfs = np.zeros(len(names))
        for r in held.groupBy("_t").agg(F.sum("n").alias("df")).collect():
            dfs[r["_t"]] = r["df"]
        raw = np.log(n - dfs + 0.5) - np.log(dfs + 0.5)
        idf = np.where(raw < 0, self.floor(), raw)
        queries = sorted({r["query"] for r in rows}, key=lambda q: (q is None, q))
        at = {q: i for i, q in enumerate(queries)}
        weights = Weights(
            len(queries), np.array([at[r["query"]] for r in rows]), np.array([place[r.term] for r in rows]),
            np.array([r.qtf * idf[place[r.term]] for r in rows]),
        )
        grown = {s: max(1.0, avgdl / r.avgdl) if r.avgdl else 1.0 for s, r in log.items()}
        key_type = {"long": "bigint"}.get(self.key_type, self.key_type)
        arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
        types = [arrow[kind], arrow[key_type], pa.float64()]

        names_of = pa.array(queries, types[0])

        def hits(q: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [names_of.take(pa.array(q, pa.int64())), pa.array(keys, types[1]), pa.array(scores, types[2])], ["query", "key", "score"]
            )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None if k is None else Best(len(queries), k)
            for segment, columns in _pages(batches):
                if best is None:
                    term, _, *lists = columns
                    docs, scores = _page_scores(weights.of(term), avgdl, *lists)
                    row, col = np.nonzero(scores > 0)
                    yield hits(row, docs[col], scores[row, col])
                else:
                    best.page(weights, grown[segment], avgdl, *columns)
            if best is not None:
                yield hits(*best.result())

        met = held.select("segment", "page", "_t", "top", "keys", "tfs", "dls")
        met = met.repartition("segment", "page").sortWithinPartitions("segment", "page")
        return met.mapInArrow(run, f"query {kind}, key {self.key_type}, score double")

    def info(self) -> DataFrame:
        """Documents, segments and the time of the last one: what tells a stale index."""
        return self.log().agg(F.sum("n_docs").alias("n_docs"), F.count("*").alias("n_segments"), F.max("added").alias("indexed_at"))


def raw_weight(n: int) -> Column:
    return F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


class Weights:
    """Weights of queries by terms, kept by term."""

    def __init__(self, n_queries: int, query: np.ndarray, term: np.ndarray, weight: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.n_queries, self.query, self.weight = n_queries, query[order], weight[order]
        self.term = term[order]

    def of(self, terms: np.ndarray) -> np.ndarray:
        """A matrix of all queries by some terms."""
        start, end = np.searchsorted(self.term, terms, "left"), np.searchsorted(self.term, terms, "right")
        n = end - start
        at = np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        out = np.zeros((self.n_queries, len(terms)))
        out[self.query[at], np.repeat(np.arange(len(terms)), n)] = self.weight[at]
        return out


def _page_scores(matrix: np.ndarray, avgdl: float, keys, tfs, dls) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a page and their scores by query, for a matrix of queries by the page's terms."""
    n = np.array([len(x) for x in keys])
    flat, tf, dl = np.concatenate(keys), np.concatenate(tfs).astype(float), np.concatenate(dls)
    docs, column = np.unique(flat, return_inverse=True)
    impact = np.zeros((len(n), len(docs)))
    impact[np.repeat(np.arange(len(n)), n), column] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
    return docs, np.round(matrix @ impact, 6)


class Best:
    """The best ``k`` documents of each query over the pages of a task."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.least = k, np.zeros(n_queries)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.skipped = 0, 0

    def page(self, weights: Weights, grown: float, avgdl: float, term, top, keys, tfs, dls) -> None:
        """Score a page: blocks of distinct terms with their lists. Queries that it cannot serve are left out."""
        matrix = weights.of(term)
        bound = np.maximum(matrix, 0) @ (np.asarray(top) * grown)
        open_ = np.flatnonzero(bound >= self.least - 1e-5)
        self.skipped += weights.n_queries - len(open_)
        if not len(open_):
            return
        docs, scores = _page_scores(matrix[open_], avgdl, keys, tfs, dls)
        row, col = np.nonzero((scores > 0) & (scores >= self.least[open_, None]))
        self.rows.append((open_[row], docs[col], scores[row, col]))
        self.held += len(row)
        if self.held > 1 << 17:
            self.result()

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cut to the best ``k`` of each query, ties by key."""
        if not self.rows:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        query, key, score = (np.concatenate(x) for x in zip(*self.rows))
        order = np.lexsort((np.unique(key, return_inverse=True)[1], -score, query))
        query, key, score = query[order], key[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, "left")
        last = place == self.k - 1
        self.least[query[last]] = score[last]
        keep = place < self.k
        self.rows = [(query[keep], key[keep], score[keep])]
        self.held = int(keep.sum())
        return self.rows[0]


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, tuple]]:
    """Pages of sorted ``(segment, page, term, top, keys, tfs, dls)`` rows, whole across batches."""
    rest = None
    for b in batches:
        table = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        table = table.combine_chunks()
        if not len(table):
            continue
        segments = np.unique(table["segment"].to_numpy(), return_inverse=True)[1]
        pages = table["page"].to_numpy()
        cuts = np.flatnonzero((np.diff(segments) != 0) | (np.diff(pages) != 0)) + 1
        starts = [0, *cuts.tolist()]
        for s, e in zip(starts, starts[1:]):
            yield _page(table.slice(s, e - s))
        rest = table.slice(starts[-1])
    if rest is not None and len(rest):
        yield _page(rest)


def _page(rows: pa.Table) -> tuple[str, tuple]:
    rows = rows.combine_chunks()
    lists = []
    for c in ("keys", "tfs", "dls"):
        column = rows[c].chunk(0)
        ends = column.offsets.to_numpy()
        flat = column.values.to_numpy(zero_copy_only=False)
        lists.append([flat[s:e] for s, e in zip(ends, ends[1:])])
    return rows["segment"][0].as_py(), (rows["_t"].to_numpy(), rows["top"].to_numpy(), *lists)


def hash_of(names: list[str]) -> int:
    return int(hashlib.sha256("\n".join(names).encode()).hexdigest()[:15], 16)
