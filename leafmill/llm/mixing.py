"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document has the key ``-ln(u) / w``: u is uniform by a hash of its id, w its quality weight. Sorted by that key
within its source, the documents are taken until the source's word budget is reached; whole epochs come first, the
sorted fraction last. The sort is never one window over a source: words are summed by bins of the key, and only the
bin in which the budget ends is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.shared import NOT_SPACE_RUN, checkpointed, join_checked

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (5, 2, 1)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE_RUN)), F.lit(0)).cast("long")


def sampling_key(id_: Column, weight: Column, seed: str = "mix") -> Column:
    """Exponential key of rate ``weight``; u comes from 52 bits of an MD5, so every engine and rerun agrees.

    ``id_`` is a row's id as text.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / float(1 << 52)
    return -F.log(u) / weight


def keyed(
    docs: DataFrame, weights: DataFrame | None, id_col: str, text_col: str, source_col: str, seed: str, keep: list[Column]
) -> DataFrame:
    """``(doc_id, source, size, key)`` and ``keep``; ``weights(id, weight)`` may lack ids (1) and repeat them (largest)."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), *keep,
        # Rows without an id are told apart by their texts.
        F.coalesce(F.col(id_col).cast("string"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("_name"),
    )
    weight = F.lit(1.0)
    if weights is not None:
        one = weights.groupBy(F.col("id").alias("_of")).agg(F.max("weight").alias("_weight"))
        rows = join_checked(rows, one, F.col("doc_id") == F.col("_of"), "left")
        weight = F.coalesce(F.when(F.col("_weight") > 0, F.col("_weight")), F.lit(1.0))
    names = [c for c in rows.columns if c not in ("_of", "_weight", "_name")]
    return rows.select(*names, sampling_key(F.col("_name"), weight, seed).alias("key"))


def targets(sizes: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """``(source, source_size)`` -> with ``target``: ``share`` of all words by weight, at most ``most`` times the size.

    Sources sorted by size over weight reach the cap first; what they leave is shared among the rest by weight. One
    row per source name is all that these windows see.
    """
    if share > most:
        raise ValueError("the sources cannot give so many words")
    pattern = F.array(*[F.lit(w) for w in WEIGHTS])
    place = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    weighed = sizes.select("*", place.alias("place")).withColumn("w", F.get(pattern, F.col("place") % len(WEIGHTS)))
    everything, before = W.partitionBy(), W.orderBy("ratio", "place").rowsBetween(W.unboundedPreceding, -1)
    z, w = F.col("source_size"), F.col("w")
    run = weighed.withColumn("ratio", z / w).select(
        "source",
        "source_size",
        "w",
        F.sum(z).over(everything).alias("all_z"),
        F.sum(w).over(everything).alias("all_w"),
        F.coalesce(F.sum(z).over(before), F.lit(0)).alias("z0"),
        F.coalesce(F.sum(w).over(before), F.lit(0)).alias("w0"),
    )
    left = F.lit(share) * F.col("all_z") - F.lit(float(most)) * F.col("z0")
    capped = left * w >= F.lit(float(most)) * z * (F.col("all_w") - F.col("w0"))
    run = run.withColumn("capped", capped)
    rest = F.lit(share) * F.col("all_z") - F.lit(float(most)) * F.sum(F.when(F.col("capped"), z).otherwise(0)).over(everything)
    free = F.sum(F.when(F.col("capped"), 0).otherwise(w)).over(everything)
    target = F.when(F.col("capped"), most * z.cast("double")).otherwise(w * rest / F.nullif(free, F.lit(0)))
    return run.select("source", "source_size", target.alias("target"))


def budgets(narrow: DataFrame, share: float = 1.5, most: int = 2, bin_rows: int = 20_000) -> DataFrame:
    """One row per source: ``source_size, target, epochs`` and the last ``(key, doc_id)`` of the fraction.

    ``narrow(doc_id, source, size, key)`` should be kept (checkpointed) by the caller.
    """
    n_bins = max(1, -(-narrow.count() // bin_rows))
    binned = narrow.withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * n_bins))
    by_bin = checkpointed(binned.groupBy("source", "bin").agg(F.sum("size").alias("words")))
    goal = targets(by_bin.groupBy("source").agg(F.sum("words").alias("source_size")), share, most)
    z = F.col("source_size")
    epochs = F.coalesce(F.least(F.floor(F.col("target") / F.nullif(z, F.lit(0))), F.lit(most)), F.lit(0))
    goal = checkpointed(goal.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * z))
    # The bin in which the fraction ends, and the words before it.
    upto = F.sum("words").over(W.partitionBy("source").orderBy("bin"))
    bins = by_bin.select("source", "bin", (upto - F.col("words")).alias("before"), upto.alias("after"))
    g = goal.select(F.col("source").alias("s"), "rest")
    ends = bins.join(g, F.col("source").eqNullSafe(F.col("s"))).where("before <= rest and rest < after")
    ends = ends.select(F.col("s"), F.col("bin").alias("b"), "before", "rest")
    inside = join_checked(binned, ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    order = W.partitionBy("source").orderBy("key", "doc_id")
    peers = F.sum("size").over(W.partitionBy("source", "key", "doc_id"))
    cut = inside.select(
        "source", "key", "doc_id", "rest", (2 * (F.col("before") + F.sum("size").over(order)) - peers).alias("twice")
    )
    last = cut.where("twice <= 2 * rest").groupBy("source").agg(F.max(F.struct("key", "doc_id")).alias("last"))
    firsts = ends.select("s", F.col("b").alias("last_bin"))
    last = last.select(F.col("source").alias("ls"), "last")
    out = goal.join(firsts, F.col("source").eqNullSafe(F.col("s")), "left")
    out = out.join(last, F.col("source").eqNullSafe(F.col("ls")), "left")
    return checkpointed(
        out.select(
            F.col("source").alias("of"), "source_size", "target", "epochs", "last_bin", "last", F.lit(n_bins).alias("n_bins")
        )
    )


def copies() -> Column:
    """How often a row of ``narrow`` joined with its budget is taken."""
    here = F.floor((1 - F.exp(-F.col("key"))) * F.col("n_bins"))
    chosen = (here < F.col("last_bin")) | (
        (here == F.col("last_bin")) & (F.struct("key", "doc_id") <= F.col("last"))
    )
    return (F.col("epochs") + F.when(F.coalesce(chosen, F.lit(False)), 1).otherwise(0)).cast("int")


def mixed(
    docs: DataFrame,
    weights: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    most: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``, one row per input row.

    ``taken`` counts a document's words once for each epoch and once more if it is in the fraction, whose last
    document is the one that comes nearest to the target. Null texts have size 0, null sources are one source; rows
    that repeat an id are taken together, and so are rows without an id that repeat a text; an empty table gives no
    rows. Reruns agree.
    """
    narrow = checkpointed(keyed(docs, weights, id_col, text_col, source_col, seed, []))
    plan = budgets(narrow, share, most)
    rows = narrow.join(plan, F.col("source").eqNullSafe(F.col("of")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mixture(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
            source_col: str = "source", share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """The mixed rows of ``docs`` themselves, each as often as it is taken. Texts are joined with one row per source."""
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    plan = budgets(checkpointed(keyed(docs, weights, id_col, text_col, source_col, seed, [])), share, most)
    rows = keyed(docs, weights, id_col, text_col, source_col, seed, [row])
    taken = join_checked(rows, plan, F.col("source").eqNullSafe(F.col("of")), max_rows=100_000)
    again = taken.select("row", F.explode(F.array_repeat(F.lit(1), copies())).alias("copy"))
    return again.select(*[F.col(f"row.{c}").alias(c) for c in docs.columns])
