"""Balanced shards by vector bin packing over bytes, tokens and rows.

Documents with equal texts form a group and stay in one shard, unless a group alone is larger than a shard; such a
group is cut into parts. Groups are not placed one by one: small ones fall into a fixed number of chunks by hash, so
the packing sees a number of items that depends on the number of shards only. Items are placed largest first, each in
the shard where the dot product of its vector with what the shard can still take is highest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.mixing import words
from leafmill.llm.shared import checkpointed, join_checked

_CELL = ["k1", "k2", "part", "sub"]
_ITEM = _CELL[:3]


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item; vectors have one row per item, one column per dimension.

    Where an item fits nowhere in all dimensions, the first one (bytes) decides alone.
    """
    total = vectors.sum(axis=0)
    v = vectors / np.where(total > 0, total / shards, 1.0)  # parts of a shard's share
    room, where = np.ones((shards, v.shape[1])), np.zeros(len(v), np.int64)
    for i in np.lexsort((-v.sum(axis=1), -v.max(axis=1))):
        fits = (room >= v[i] - 1e-12).all(axis=1)
        score = room @ v[i]
        k = int(np.argmax(np.where(fits, score, -np.inf) if fits.any() else room[:, 0]))
        where[i] = k
        room[k] -= v[i]
    return where


def _measured(docs: DataFrame, id_col: str, text_col: str, overhead: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        words(text).alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(text, F.lit("second")).alias("h2"),
    )


def shard(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 16,
    cells_per_shard: int = 512,
) -> DataFrame:
    """``(doc_id, size, tokens, text_crc32, shard, slot)``, one row per input row.

    ``size`` is the UTF-8 bytes of the text (null: none) plus ``overhead``; tokens are words. Slots count from 0
    without gaps in each shard. Null and empty texts are one group; repeated rows are rows of their own and share
    their group; an empty table gives no rows. At most ``5 * shards * cells_per_shard`` cells are ever placed or
    broadcast.
    """
    n_cells = shards * cells_per_shard
    rows = checkpointed(_measured(docs, id_col, text_col, overhead))
    group = rows.groupBy("h1", "h2").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r"))
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    share = F.greatest(*[F.col(c) / float(n or 1) for c, n in zip("btr", total)])
    # At most n_cells groups reach a share of 1 / n_cells in each dimension.
    large = group.select("h1", "h2", share.alias("share")).where(F.col("share") * n_cells >= 1)
    large = checkpointed(
        large.select(
            F.col("h1").alias("g1"),
            F.col("h2").alias("g2"),
            F.ceil(F.col("share") * n_cells).alias("subs"),
            F.when(F.col("share") * shards > 1, F.ceil(F.col("share") * shards * 4)).otherwise(1).alias("parts"),
        )
    )
    own = join_checked(rows, large, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left", 3 * n_cells)
    is_large, draw = F.col("g1").isNotNull(), F.xxhash64("doc_id", F.lit("part"))
    sub = F.when(is_large, F.pmod(draw, F.col("subs"))).otherwise(0)
    cells = own.select(
        "doc_id",
        "size",
        "tokens",
        "text_crc32",
        F.when(is_large, F.col("h1")).otherwise(F.pmod("h1", F.lit(n_cells))).alias("k1"),
        F.when(is_large, F.col("h2")).otherwise(F.lit(0)).alias("k2"),
        F.when(is_large, F.pmod(sub, F.col("parts"))).otherwise(-1).cast("int").alias("part"),
        sub.cast("int").alias("sub"),
    )
    sums = checkpointed(
        cells.groupBy(*_CELL).agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r"))
    )
    items = sums.groupBy(*_ITEM).agg(*[F.sum(c).alias(c) for c in "btr"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if frames:
            every = pd.concat(frames).sort_values(_ITEM, ignore_index=True)
            yield every[_ITEM].assign(shard=place(every[["b", "t", "r"]].to_numpy(float), shards))

    placed = items.repartition(1).mapInPandas(run, "k1 long, k2 long, part int, shard int")
    order = W.partitionBy("shard").orderBy(*_CELL)
    offset = F.sum("r").over(order) - F.col("r")
    starts = checkpointed(sums.join(placed, _ITEM).select(*_CELL, "shard", offset.alias("offset")))
    within = F.row_number().over(W.partitionBy(*_CELL).orderBy("doc_id", "size", "text_crc32")) - 1
    out = join_checked(cells, starts, _CELL, max_rows=5 * n_cells)
    return out.select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("offset") + within).alias("slot"))


def write_shards(docs: DataFrame, plan: DataFrame, path: str, id_col: str = "doc_id", rows_per_file: int = 1_000_000) -> None:
    """Write ``docs`` as Parquet folders ``shard=N``, rows in slot order; ids must be unique.

    Columns of ``docs`` that are named like one of the plan's get underscores behind.
    """
    names = []
    for c in docs.columns:
        name = c
        while name.lower() in ("shard", "slot", "_of") or (name != c and name in docs.columns):
            name += "_"
        names.append(name)
    p = plan.select(F.col("doc_id").alias("_of"), "shard", "slot")
    own = docs.toDF(*names)
    rows = own.join(p, F.col(names[docs.columns.index(id_col)]).eqNullSafe(F.col("_of"))).drop("_of")
    file_no = F.floor(F.col("slot") / rows_per_file)
    ordered = rows.repartition("shard", file_no).sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
