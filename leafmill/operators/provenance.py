"""Text spans, highlight colours, version ids and version differences."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import text as X


def highlight_color(score: Column) -> Column:
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0))))
    return F.when(s >= 0.85, "green").when(s >= 0.60, "yellow").otherwise("red")


def find_text_span(page: Column, chunk: Column, search: int | None = None, prefix: int | None = None) -> Column:
    """struct(start, end, stage): the whole chunk exactly (1), its first ``prefix`` characters if asked for (2), or the
    whole chunk with any white space between words (3).

    ``end`` is the end of what was matched. ``search`` limits how far into the page to look; by default the whole page
    counts.
    """
    page = F.substring(page, 1, search) if search else page
    needle = X.strip(chunk)
    norm = X.strip(F.regexp_replace(needle, r"(?U)\s+", " "))
    pattern = F.concat(
        F.lit("(?U)"), F.regexp_replace(F.regexp_replace(norm, r"([^\p{L}\p{N}\s])", r"\\$1"), " ", r"\\s+")
    )
    exact = F.position(needle, page)
    short = X.strip(F.substring(needle, 1, prefix)) if prefix else F.lit("")
    partial = F.when(F.length(short) >= 20, F.position(short, page)).otherwise(0)
    loose = F.regexp_instr(page, pattern)
    start = F.when(exact > 0, exact).when(partial > 0, partial).when(loose > 0, loose) - 1
    stage = F.when(exact > 0, 1).when(partial > 0, 2).when(loose > 0, 3).otherwise(0)
    length = (
        F.when(exact > 0, F.length(needle))
        .when(partial > 0, F.length(short))
        .when(loose > 0, F.length(F.regexp_substr(page, pattern)))
    )
    end = start + length
    blank = (needle == "") | (X.strip(page) == "")
    return F.when(~blank, F.struct(start.alias("start"), end.alias("end"), stage.alias("stage")))


def version_id(text: Column, ts: Column) -> Column:
    return F.concat(F.substring(F.sha2(text, 256), 1, 16), F.lit("_"), F.unix_millis(ts).cast("string"))


def line_sets(old: Column, new: Column) -> dict[str, Column]:
    """Set form of a line diff."""
    a = F.array_distinct(F.filter(F.transform(F.split(old, "\n"), X.strip), lambda x: x != ""))
    b = F.array_distinct(F.filter(F.transform(F.split(new, "\n"), X.strip), lambda x: x != ""))
    return {
        "added": F.array_except(b, a),
        "removed": F.array_except(a, b),
        "kept": F.array_intersect(a, b),
    }


def change_summary(added: Column, removed: Column, modified: Column, similarity: Column) -> Column:
    parts = F.array_compact(
        F.array(
            F.when(added > 0, F.format_string("%d lines added", added)),
            F.when(removed > 0, F.format_string("%d lines removed", removed)),
            F.when(modified > 0, F.format_string("%d sections modified", modified)),
        )
    )
    return (
        F.when(similarity >= 0.99, "Minor formatting or whitespace changes only.")
        .when(F.size(parts) == 0, "Document content unchanged.")
        .otherwise(
            F.concat(
                F.lit("Changes detected: "), F.array_join(parts, ", "),
                F.format_string(". Similarity: %.1f%%.", similarity * 100),
            )
        )
    )


@F.pandas_udf(
    T.StructType(
        [T.StructField(c, T.IntegerType()) for c in ("n_added", "n_removed", "n_modified")]
        + [T.StructField("similarity", T.DoubleType())]
    )
)
def line_opcodes(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Ordered line diff of each (old, new) pair."""

    def one(old: str, new: str) -> tuple[int, int, int, float]:
        a, b = old.splitlines(keepends=True), new.splitlines(keepends=True)
        m = difflib.SequenceMatcher(None, a, b)
        n = {"insert": 0, "delete": 0, "replace": 0}
        for tag, i1, i2, j1, j2 in m.get_opcodes():
            if tag == "insert":
                n[tag] += sum(1 for x in b[j1:j2] if x.strip())
            elif tag == "delete":
                n[tag] += sum(1 for x in a[i1:i2] if x.strip())
            elif tag == "replace":
                n[tag] += 1
        return n["insert"], n["delete"], n["replace"], m.ratio()

    cols = ["n_added", "n_removed", "n_modified", "similarity"]
    for old, new in batches:
        yield pd.DataFrame([one(o or "", n or "") for o, n in zip(old, new)], columns=cols)
