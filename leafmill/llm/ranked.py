"""Ranked lexical search by dense blocked matrix products.

Items are the query side: a bounded tile of them at a time, its terms collected as one vocabulary. Documents are cut
into words once per tile; only the asked terms' counts are stored. A task then multiplies impact tiles (documents by a
compact vocabulary) with weight tiles (the same vocabulary by items) in float64. All entries are whole numbers and the
vocabulary is cut so that no sum reaches 2**53, so the products are exact in any order of adding; sums over vocabulary
tiles are 64-bit integers. Each task keeps its best ``k`` per item with ties decided by the smaller key, so its output
is bounded by ``k`` rows an item, and a window ranks what the tasks kept.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.shared import stored
from leafmill.llm.slices import byte_table, slices

#: Bytes of terms (with their item) in one tile of items; what the driver and each task hold of the query side.
TILE_BYTES = 16 << 20
#: Shape of the dense tiles: documents, vocabulary, items (16 MB, 2 MB and 0.25 MB of float64).
TILE_DOCS, TILE_TERMS, TILE_ITEMS = 512, 4096, 64
#: Every impact is below this: (10**9 * tf) div (1000 * tf + 20 * m).
IMPACT_BOUND = 1_000_000
#: Whole numbers of float64 are exact up to here.
EXACT = 1 << 53

#: Bytes 00-2F, 3A-40, 5B-60 and 7B-7F end a term.
_FOLD = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def term_counts(text: bytes | None) -> Counter:
    """Occurrences of each term (A-Z lower-cased) in a whole UTF-8 text; none for a null text."""
    counts: Counter = Counter()
    for piece in slices(text.translate(_FOLD)) if text else ():
        counts.update(piece.split())
    return counts


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct ``(item, term)`` rows; rows that repeat a key are one item with the terms of all."""
    src = items.select(F.col(key).alias("item"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [list(term_counts(x.as_py())) for x in b.column(1)]
            rows = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows)), pa.array([t for ts in terms for t in ts], pa.binary())], ["item", "term"]
            )

    kind = src.schema["item"].dataType.simpleString()
    return src.mapInArrow(run, f"item {kind}, term binary").distinct()


def postings(docs: DataFrame, vocabulary: list[bytes], key: str, text: str) -> DataFrame:
    """``(key, n, terms, tfs)`` of every document with a term: its length and the asked terms' places and counts."""
    src = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    place = {t: i for i, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, lengths, ends, terms, tfs = [], [], [0], [], []
            for i, x in enumerate(b.column(1)):
                counts = term_counts(x.as_py())
                if not counts:
                    continue
                rows.append(i)
                lengths.append(counts.total())
                for t in counts.keys() & place.keys():
                    terms.append(place[t])
                    tfs.append(counts[t])
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64())),
                ],
                ["key", "n", "terms", "tfs"],
            )

    kind = src.schema["key"].dataType.simpleString()
    return src.mapInArrow(run, f"key {kind}, n long, terms array<int>, tfs array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Tile:
    """Items with a compact vocabulary: ``column_of`` maps terms to columns, ``parts`` cut the columns, ``weights`` fill them."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray):
        terms = np.unique(np.concatenate(items))
        cost = np.cumsum(weights[terms] * IMPACT_BOUND)
        self.column_of = np.full(len(weights), -1, np.int64)
        self.column_of[terms] = np.arange(len(terms))
        self.weights = np.zeros((len(terms), len(items)))
        for j, own in enumerate(items):
            self.weights[self.column_of[own], j] = weights[own]
        self.parts, start = [], 0
        while start < len(terms):
            spent = int(cost[start - 1]) if start else 0
            end = int(min(np.searchsorted(cost, spent + EXACT, "left"), start + TILE_TERMS))
            self.parts.append((start, max(end, start + 1)))
            start = self.parts[-1][1]

    def scores(self, n_docs: int, row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """Exact scores, documents by items, of a tile of documents given as (row, term, impact) entries."""
        column = self.column_of[term]
        out = np.zeros((n_docs, self.weights.shape[1]), np.int64)
        for start, end in self.parts:
            inside = (column >= start) & (column < end)
            dense = np.zeros((n_docs, end - start))
            dense[row[inside], column[inside] - start] = impact[inside]
            out += (dense @ self.weights[start:end]).astype(np.int64)
        return out


class Best:
    """The ``k`` best (score descending, null keys last, key ascending) of each item among what was offered."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor = k, np.ones(n_items, np.int64)
        self.kept = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
        self.new: list[tuple[np.ndarray, ...]] = []

    def offer(self, first: int, scores: np.ndarray, keys: np.ndarray, nulls: np.ndarray) -> None:
        rows, cols = np.nonzero(scores >= self.floor[first : first + scores.shape[1]])
        self.new.append((cols + first, scores[rows, cols], keys[rows], nulls[rows]))
        if sum(len(x[0]) for x in self.new) > 1 << 18:
            self.cut()

    def cut(self) -> None:
        item, score, key, null = (np.concatenate(x) for x in zip(self.kept, *self.new))
        order = np.lexsort((key, null, -score, item))
        item, score, key, null = (x[order] for x in (item, score, key, null))
        place = np.arange(len(item)) - np.searchsorted(item, item, "left")
        keep = place < self.k
        last = place == self.k - 1  # an equal score may still win by its key
        self.floor[item[last]] = score[last]
        self.kept, self.new = [x[keep] for x in (item, score, key, null)], []


def _best_of_tasks(rows: DataFrame, items: list, own: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int, kind: str) -> DataFrame:
    """``(item_id, doc_id, score)``: each task's best ``k`` documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = [Tile(own[i : i + TILE_ITEMS], weights) for i in range(0, len(own), TILE_ITEMS)]
        best = Best(len(own), k)
        for b in batches:
            for start in range(0, len(b), TILE_DOCS):
                t = b.slice(start, TILE_DOCS)
                keys = t.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                nulls = t.column(0).is_null().to_numpy(zero_copy_only=False)
                n = t.column(1).to_numpy()
                ends = t.column(2).value_lengths().to_numpy()
                row = np.repeat(np.arange(len(t)), ends)
                tf = t.column(3).flatten().to_numpy()
                m = 50 + np.array([50 * int(x) * n_docs // n_terms for x in n], np.int64)
                impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[row])
                for j, tile in enumerate(tiles):
                    best.offer(j * TILE_ITEMS, tile.scores(len(t), row, t.column(2).flatten().to_numpy(), impact), keys, nulls)
        best.cut()
        item, score, key, null = best.kept
        item_type, key_type = kinds
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([items[i] for i in item], item_type),
                pa.array(key, pa.int64(), mask=null).cast(key_type),
                pa.array(score, pa.int64()),
            ],
            ["item_id", "doc_id", "score"],
        )

    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    key_kind = rows.schema["key"].dataType.simpleString()
    kinds = (arrow[kind], arrow[key_kind])
    return rows.select("key", "n", "terms", "tfs").mapInArrow(run, f"item_id {kind}, doc_id {key_kind}, score long")


def search(
    items: DataFrame, docs: DataFrame, k: int = 50, item_key: str = "item_id", doc_key: str = "doc_id", text: str = "text",
    tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` highest-scoring documents of each item, scores above 0 only.

    Equal scores go by ascending key, null keys last; rows that repeat a document are ranked each. Null and empty
    texts have no terms: such an item finds nothing, such a document is found by nothing and counts nowhere. Rows that
    repeat an item key are one item. Keys of documents are whole numbers. Tables without rows give none. Items come in
    tiles by the hash of their key; a tile holds ``tile_bytes`` of terms, or one item's terms where these are more.
    """
    spark = docs.sparkSession
    terms = stored(item_terms(items, item_key, text))
    kind = terms.schema["item"].dataType.simpleString()
    size = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    n_tiles = -(-size // tile_bytes)
    out = spark.createDataFrame([], f"item_id {kind}, doc_id {docs.schema[doc_key].dataType.simpleString()}, score long")
    for tile in range(n_tiles):
        mine = terms.where(F.pmod(F.xxhash64("item"), F.lit(n_tiles)) == tile).collect()
        if not mine:
            continue
        vocabulary = sorted({bytes(r.term) for r in mine})
        place = {t: i for i, t in enumerate(vocabulary)}
        lists: dict = {}
        for r in mine:
            lists.setdefault(r["item"], []).append(place[bytes(r.term)])
        rows = stored(postings(docs, vocabulary, doc_key, text))
        n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
        dfs = np.zeros(len(vocabulary), np.int64)
        for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most one row a term
            dfs[r["t"]] = r["count"]
        weights = np.array([weight(n_docs, int(df)) for df in dfs], np.int64)
        own = [np.array(sorted(v), np.int64) for v in lists.values()]
        out = out.unionByName(_best_of_tasks(rows, list(lists), own, weights, n_docs, n_terms or 1, k, kind))
    order = [F.desc("score"), F.col("doc_id").isNull(), F.col("doc_id")]
    part = out.withColumn("_part", F.spark_partition_id() % 64)
    few = part.withColumn("_at", F.row_number().over(W.partitionBy("item_id", "_part").orderBy(*order))).where(F.col("_at") <= k)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
