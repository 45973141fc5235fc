"""Quality rules with adaptive thresholds: what is usual for a language and source decides what is odd.

Each measure of each (language, source) is summed up in a mergeable quantile sketch: counts over log-linear bins
(exact below 64, at most 1/32 wide beyond), which add up bin by bin in any order, so reruns agree. Sketches of groups
with few documents are replaced by the merged sketch of their language, then of all documents. The thresholds are
joined back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.shared import SPACE_RUN, SPACES, checkpointed, let

#: Measures (parts per 10,000, word length in hundredths) with the least limit that an upper fence may take.
MEASURES = {"m_symbols": 1_000, "m_dup_lines": 5_000, "m_repeats": 3_000, "m_length": 0}
#: The measure that has a lower fence as well.
TWO_SIDED = "m_length"


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def _repeated_words(words: Column, windows: Column) -> Column:
    """Words covered by three-word windows whose hash occurs at least twice in ``windows``."""

    def covered(s: Column) -> Column:
        # Windows in hash order; those with an equal neighbour repeat. Their places, sorted, cover 3 words each.
        same = F.transform(
            s,
            lambda x, i: F.when(
                F.when(i > 0, F.get(s, i - 1)["h"] == x["h"]).otherwise(False)
                | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
                x["i"],
            ),
        )
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            F.array_sort(F.array_compact(same)),
            start,
            lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    in_order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    few = F.size(F.array_distinct(windows)) == F.size(windows)
    return F.when(F.size(words) < 4, 0).when(few, 0).otherwise(let(in_order, covered))


def measures(docs: DataFrame, text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """Counts of each text beside the ``keep`` columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines.

    One narrow pass over whole texts. Three-word windows are compared by 64-bit hash inside one text.
    """
    keep = keep or {}
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.filter(F.split(text, "\n"), lambda line: F.length(_trim(line)) > 0)
    split = F.split(_trim(text), SPACE_RUN)
    first = docs.select(
        *[c.alias(n) for n, c in keep.items()],
        F.when(_trim(text) == "", F.array().cast("array<string>")).otherwise(split).alias("_words"),
        bare.alias("_lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    w = F.col("_words")
    hashes = F.when(
        F.size(w) >= 4,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        ),
    )
    second = first.select(
        *keep,
        "n_symbols",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "_words",
        hashes.alias("_windows"),
    )
    return second.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        _repeated_words(w, F.col("_windows")).cast("long").alias("n_repeat_words"),
        "n_lines",
    )


def _bin(v: Column) -> Column:
    e = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (e * 32 + F.call_function("shiftright", v, e)).cast("int")


def _edge(b: Column) -> Column:
    """Largest value of a bin."""
    e = F.greatest(F.floor(b / 32).cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", (b - e * 32 + 1).cast("long"), e) - 1


def sketches(measured: DataFrame) -> DataFrame:
    """``(lang, source, measure, bin, n)`` over documents that pass the fixed rules; combined before the shuffle."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), _bin(F.col(m)).alias("bin")) for m in MEASURES]))
    rows = measured.where(~F.col("base_failed")).select("lang", "source", values.alias("v"))
    return rows.groupBy("lang", "source", "v.measure", "v.bin").agg(F.count("*").alias("n"))


def _quartiles(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Quartile bins of each merged sketch; a sketch has at most a few hundred bins."""
    merged = bins.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*keys, "measure")
    running = merged.select(
        *keys,
        "measure",
        "bin",
        F.sum("n").over(group.orderBy("bin")).alias("upto"),
        F.sum("n").over(group).alias("total"),
    )
    return running.groupBy(*keys, "measure").agg(
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bin"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bin"))).alias("q3"),
        F.max("total").alias("total"),
    )


def thresholds(bins: DataFrame, fence: int = 5, min_docs: int = 200) -> DataFrame:
    """``(lang, source, low, m_symbols, ...)``: far-out fences per language and source.

    They lie ``fence`` times the distance of the quartiles beyond them, and at least a quarter of the quartile, so that
    a group of like documents does not reject the slightly unlike.
    """
    own = _quartiles(bins, ["lang", "source"])
    lang = _quartiles(bins, ["lang"]).select(
        F.col("lang").alias("l"), F.col("measure").alias("m"), F.struct("q1", "q3", "total").alias("by_lang")
    )
    every = _quartiles(bins, []).select(F.col("measure").alias("em"), F.struct("q1", "q3", "total").alias("by_all"))
    joined = own.join(lang, own.lang.eqNullSafe(lang.l) & (own.measure == lang.m)).join(every, F.col("measure") == F.col("em"))
    q = (
        F.when(F.col("total") >= min_docs, F.struct("q1", "q3", "total"))
        .when(F.col("by_lang.total") >= min_docs, F.col("by_lang"))
        .otherwise(F.col("by_all"))
    )
    q1, q3 = _edge(F.col("q.q1")), _edge(F.col("q.q3"))
    floors = F.element_at(F.create_map(*[F.lit(x) for m in MEASURES.items() for x in m]), F.col("measure"))
    fences = joined.withColumn("q", q).select(
        "lang",
        "source",
        "measure",
        F.greatest(q3 + F.greatest(fence * (q3 - q1), F.shiftright(q3, 2)), floors.cast("long")).alias("upper"),
        (q1 - F.greatest(fence * (q3 - q1), F.shiftright(q1, 2))).alias("low"),
    )
    return fences.groupBy("lang", "source").agg(
        F.max(F.when(F.col("measure") == TWO_SIDED, F.col("low"))).alias("low"),
        *[F.max(F.when(F.col("measure") == m, F.col("upper"))).alias(f"upper_{m}") for m in MEASURES],
    )


def _share(part: str, whole: str, scale: int = 10_000) -> Column:
    return F.coalesce(F.floor(F.col(part) * scale / F.nullif(F.col(whole), F.lit(0))).cast("long"), F.lit(0).cast("long"))


def judged(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    fence: int = 5,
    min_docs: int = 200,
) -> DataFrame:
    """``doc_id``, the measures, ``base_failed`` and ``kept``; one row per input row.

    Null texts have no words and fail. Null languages and sources are groups of their own. A group without any
    document that passes the fixed rules keeps nothing, as all of it fails; an empty table gives no rows.
    """
    keep = {"doc_id": F.col(id_col), "lang": F.col(lang_col), "source": F.col(source_col)}
    counted = measures(docs, text_col, keep)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = checkpointed(
        counted.select(
            "*",
            failed.alias("base_failed"),
            _share("n_symbols", "n_words").alias("m_symbols"),
            _share("n_dup_lines", "n_lines").alias("m_dup_lines"),
            _share("n_repeat_words", "n_words").alias("m_repeats"),
            _share("word_chars", "n_words", 100).alias("m_length"),
        )
    )
    limits = thresholds(sketches(measured), fence, min_docs)
    limits = limits.select(F.col("lang").alias("l"), F.col("source").alias("s"), "low", *[f"upper_{m}" for m in MEASURES])
    usual = F.col(TWO_SIDED) >= F.col("low")
    for m in MEASURES:
        usual = usual & (F.col(m) <= F.col(f"upper_{m}"))
    rows = measured.join(limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.coalesce(usual, F.lit(False))).alias("kept"),
    )
