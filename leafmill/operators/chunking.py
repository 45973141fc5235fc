"""Documents to blocks, parents, children and ids."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators.running import running
from leafmill.sources.scratch import written


def text_blocks(docs: DataFrame, max_blocks: int | None = None, min_chars: int = 1, per_page: int = 10) -> DataFrame:
    """One row per line with text: ``block_index`` counts all lines; ``max_blocks`` and ``min_chars`` leave out more if asked."""
    lines = F.split("text", "\n")
    if max_blocks:
        lines = F.slice(lines, 1, max_blocks)
    keep = [c for c in docs.columns if c != "text"]
    return (
        docs.select(*keep, F.posexplode(lines).alias("block_index", "raw"))
        .select(
            *keep,
            "block_index",
            F.floor(F.col("block_index") / per_page).cast("int").alias("page"),
            X.strip(F.col("raw")).alias("text"),
        )
        .where(F.length("text") >= min_chars)
    )


def fixed_windows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Character windows that start every ``size - overlap`` characters."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size")
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(step))
    keep = [c for c in docs.columns if c != "text"]
    return docs.where(F.length("text") > 0).select(
        *keep, "text", F.posexplode(starts).alias("chunk_index", "start")
    ).select(*keep, "chunk_index", "start", F.col("text").substr(F.col("start") + 1, F.lit(size)).alias("text"))


def chunk_id(doc: Column, source: Column, page: Column, index: Column, text: Column) -> Column:
    """Id of a block: two documents of one source, or two texts with the same beginning, never share one."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (doc, source, page, index, text)]
    raw = F.concat_ws(":", *parts)
    return F.substring(F.sha2(raw, 256), 1, 32)


# Separators tried in this order.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split_recursive(text: str, size: int, overlap: int, separators=SEPARATORS) -> list[str]:
    """Split on the first separator that occurs, pack pieces up to ``size`` with ``overlap`` carried over."""
    sep, rest = separators[-1], ()
    for i, s in enumerate(separators):
        if s == "" or s in text:
            sep, rest = s, separators[i + 1 :]
            break
    if sep:
        head, *tail = text.split(sep)
        pieces = ([head] if head else []) + [sep + p for p in tail]
    else:
        pieces = list(text)
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            joined = "".join(run).strip()
            if joined:
                out.append(joined)

    for piece in pieces:
        if len(piece) > size and rest:
            flush()
            run.clear()
            out.extend(split_recursive(piece, size, overlap, rest))
            continue
        if run and sum(map(len, run)) + len(piece) > size:
            flush()
            while run and (sum(map(len, run)) > overlap or sum(map(len, run)) + len(piece) > size):
                run.pop(0)
        run.append(piece)
    flush()
    return out


def parent_child_chunks(
    blocks: DataFrame,
    child_size: int = 400,
    child_overlap: int = 50,
    parent_size: int = 2000,
    parent_overlap: int = 200,
) -> DataFrame:
    """Each block is a parent; its children are the recursive split. Blocks spread over all tasks."""
    if child_overlap >= child_size or parent_overlap >= parent_size or child_size >= parent_size:
        raise ValueError("overlap must be below size, child size below parent size")

    @F.pandas_udf("array<string>")
    def children(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: split_recursive(t, child_size, child_overlap))

    return blocks.withColumn(
        "parent_id", chunk_id(*[F.col(c) for c in ("doc_id", "source", "page", "block_index", "text")])
    ).select(
        "doc_id", "source", "page", "block_index", "parent_id",
        F.length("text").alias("parent_chars"),
        F.posexplode(children("text")).alias("child_index", "text"),
    ).withColumn(
        "chunk_id",
        F.substring(F.sha2(F.concat_ws(":", "doc_id", "parent_id", "child_index", "text"), 256), 1, 32),
    )


def pack_words(items: Column, max_words: int, sep: str) -> Column:
    """Greedy packing of an array of texts, in order, without splitting a text."""
    empty = F.struct(
        F.array().cast("array<array<string>>").alias("done"),
        F.array().cast("array<string>").alias("cur"),
        F.lit(0).alias("n"),
    )

    def step(acc: Column, item: Column) -> Column:
        words = F.size(X.split_space(item))
        full = (acc["n"] + words > max_words) & (F.size(acc["cur"]) > 0)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(item)).otherwise(F.concat(acc["cur"], F.array(item))).alias("cur"),
            F.when(full, words).otherwise(acc["n"] + words).alias("n"),
        )

    def finish(acc: Column) -> Column:
        groups = F.when(F.size(acc["cur"]) > 0, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
        return F.transform(groups, lambda g: F.array_join(g, sep))

    return F.aggregate(items, empty, step, finish)


def word_windows(words: Column, n: int) -> Column:
    """Windows of ``n`` consecutive words, joined by a space."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(n))
    return F.transform(starts, lambda s: F.array_join(F.slice(words, s, n), " "))


def pack_segments(segments: DataFrame, key: str, at: str, text: str, max_words: int = 200, bin_rows: int = 4096) -> DataFrame:
    """``(key, chunk_index, chunk)``: a key's texts in the order of ``at``, packed greedily into chunks of ``max_words``.

    A chunk ends before the text that would take it beyond ``max_words``; a longer text is a chunk of its own. Where a
    chunk that begins at a text ends follows from running word counts, for all texts at once. Which texts do begin a chunk
    is found by jumps of doubling length from the first one, so a key's texts are never gathered and a key of any number
    of texts takes a logarithmic number of rounds. ``at`` is unique within its key.
    """
    src = segments.select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(text).alias("text"))
    words = F.greatest(F.size(X.split_space(F.coalesce("text", F.lit("")))), F.lit(0)).cast("long")
    place = running(src.withColumn("w", words), ["key"], [F.col("at")], F.floor(F.col("at") / bin_rows), {
        "i": ("sum", F.lit(1).cast("long")), "upto": ("sum", F.col("w")),
    })
    rows = written(place.select("key", "i", "text", "upto", (F.col("upto") - F.col("w")).alias("before")), "segments")
    # The first text whose running count passes this one's start by more than the limit: counts and starts in one order,
    # from the highest down, and the lowest place seen so far.
    marks = rows.select("key", F.col("upto").alias("v"), F.lit(0).alias("asks"), F.col("i").alias("found"), F.lit(None).cast("long").alias("i"))
    asks = rows.select("key", (F.col("before") + max_words).alias("v"), F.lit(1).alias("asks"), F.lit(None).cast("long").alias("found"), "i")
    order = [F.desc("v"), F.desc("asks")]
    grain = F.lit(max(bin_rows, max_words) * 8)
    told = running(marks.unionByName(asks), ["key"], order, -F.floor(F.col("v") / grain), {"next": ("min", F.col("found"))})
    jump = written(told.where("asks = 1 and next is not null").select("key", "i", F.greatest("next", F.col("i") + 1).alias("to")), "jumps")
    starts = written(rows.where("i = 1").select("key", "i"), "starts")
    while True:
        reached = starts.join(jump, ["key", "i"]).select("key", F.col("to").alias("i"))
        if reached.isEmpty():
            break
        starts = written(starts.unionByName(reached).distinct(), "starts")
        on = jump.select("key", F.col("i").alias("to"), F.col("to").alias("_far"))
        jump = written(jump.join(on, ["key", "to"]).select("key", "i", F.col("_far").alias("to")), "jumps")
    flagged = rows.join(starts.withColumn("_s", F.lit(1)), ["key", "i"], "left")
    numbered = running(flagged, ["key"], [F.col("i")], F.floor(F.col("i") / bin_rows), {"_c": ("sum", F.coalesce("_s", F.lit(0)))})
    texts = F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda s: F.coalesce(s["text"], F.lit("")))
    chunks = numbered.groupBy("key", "_c").agg(F.array_join(texts, "\n").alias("chunk"))
    return chunks.select(F.col("key").alias(key), (F.col("_c") - 1).cast("int").alias("chunk_index"), "chunk")
