"""Predicates built from specs: metadata filters, workflow rules, searches, routing."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Filter grammar.
ALLOWED_KEYS = ("workspace_id", "document_type", "language", "source_file", "page_number", "block_type", "tags")
OPERATORS = ("$gte", "$lte", "$gt", "$lt", "$eq", "$ne", "$in", "$nin")


def validate_filter(spec: dict[str, Any], allowed=ALLOWED_KEYS) -> None:
    """Raise ValueError for an unknown key or operator; runs no job."""
    for key, cond in spec.items():
        if key not in allowed:
            raise ValueError(f"filter key not allowed: {key}")
        if isinstance(cond, dict):
            bad = [op for op in cond if op not in OPERATORS]
            if bad:
                raise ValueError(f"operator not allowed for {key}: {bad[0]}")
            for op in ("$in", "$nin"):
                if op in cond and not isinstance(cond[op], (list, tuple)):
                    raise ValueError(f"{op} needs a list")


def _same_kind(dtype: str, value: Any) -> bool:
    if dtype.startswith("array<"):
        dtype = dtype[6:-1]
    text = dtype == "string"
    return text == isinstance(value, str)


def metadata_filter(df: DataFrame, spec: dict[str, Any], allowed=None) -> Column:
    """Spec to predicate. Missing values fail, lists test membership, text and numbers never mix."""
    if allowed is not None:
        validate_filter(spec, allowed)
    types = dict(df.dtypes)
    out = F.lit(True)

    def equal(c: Column, dtype: str, v: Any) -> Column:
        if not _same_kind(dtype, v):
            return F.lit(False)
        return F.array_contains(c, v) if dtype.startswith("array<") else c == F.lit(v)

    for key, cond in spec.items():
        c, dtype = F.col(key), types[key]
        if cond is None:
            out = out & c.isNull()
            continue
        for op, v in (cond if isinstance(cond, dict) else {"$eq": cond}).items():
            if op == "$eq":
                p = equal(c, dtype, v)
            elif op == "$ne":
                p = ~equal(c, dtype, v)
            elif op in ("$in", "$nin"):
                p = F.lit(False)
                for x in v:
                    p = p | equal(c, dtype, x)
                p = ~p if op == "$nin" else p
            elif not _same_kind(dtype, v):
                p = F.lit(False)
            else:
                p = {"$gte": c >= v, "$lte": c <= v, "$gt": c > v, "$lt": c < v}[op]
            out = out & F.coalesce(p & c.isNotNull(), F.lit(False))
    return out


def coerce_metadata(df: DataFrame, ints: list[str], floats: list[str], required: list[str]) -> DataFrame:
    """Numbers with a 0 fallback; ``valid`` is false where a required field is missing."""
    casts = {c: F.coalesce(F.col(c).try_cast("int"), F.lit(0)) for c in ints}
    casts |= {c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in floats}
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    return df.withColumn("valid", ok).withColumns(casts)


def condition(field: Column, op: str, value: Any) -> Column:
    """One workflow condition; a missing field or a failed cast is false."""
    text = F.lower(field.cast("string"))
    num = field.cast("string").try_cast("double")
    if op in ("gt", "lt", "gte", "lte"):
        try:
            v = float(value)
        except (TypeError, ValueError):
            return F.lit(False)
        p = {"gt": num > v, "lt": num < v, "gte": num >= v, "lte": num <= v}[op]
    elif op == "eq":
        p = text == str(value).lower()
    elif op == "neq":
        p = text != str(value).lower()
    elif op == "contains":
        p = F.contains(text, F.lit(str(value).lower()))
    elif op == "not_contains":
        p = ~F.contains(text, F.lit(str(value).lower()))
    elif op == "in":
        p = text.isin(*[str(v).lower() for v in value or []]) if value else F.lit(False)
    elif op == "regex":
        p = field.cast("string").rlike("(?iU)" + str(value))
    else:
        return F.lit(False)
    return F.coalesce(p, F.lit(False))


def workflow_hits(docs: DataFrame, rules: list[dict[str, Any]], keep: list[str]) -> DataFrame:
    """One row per (document, matching rule): one scan, rules as an array of flags."""
    hits = []
    for r in rules:
        p = F.lit(True)
        for c in r["conditions"]:
            p = p & (condition(F.col(c["field"]), c["operator"], c["value"]) if c["field"] in docs.columns else F.lit(False))
        hits.append(F.when(p, F.struct(F.lit(r["name"]).alias("rule"), F.lit(r["action"]).alias("action"))))
    return docs.select(*keep, F.explode(F.array_compact(F.array(*hits))).alias("h")).select(*keep, "h.rule", "h.action")


def search(
    df: DataFrame, needle: str | None, columns: list[str], equals: dict[str, Any], order: list, limit: int, offset: int = 0
) -> DataFrame:
    """Case-insensitive substring over several columns, equality filters, newest first, one page."""
    for k, v in equals.items():
        if v is not None:
            df = df.where(F.col(k) == v)
    if needle:
        p = F.lit(False)
        for c in columns:
            p = p | F.col(c).cast("string").ilike(f"%{needle}%")
        df = df.where(p)
    return df.orderBy(*order).offset(offset).limit(limit)


def route_after_analysis(route: Column) -> Column:
    return (
        F.when(route == "graph", "graph_retriever")
        .when(route == "hybrid", "hybrid_retrieve_start")
        .otherwise("vector_retriever")
    )


def route_after_grading(action: Column, retries: Column, max_retries: int = 2) -> Column:
    return (
        F.when(action == "filter_and_supplement", "web_search")
        .when((action == "rewrite") & (retries < max_retries), "query_rewriter")
        .when(action == "rewrite", "web_search")
        .when(action == "decompose", "query_decomposer")
        .otherwise("answer_generator")
    )


def grading_action(relevant: Column, ambiguous: Column, total: Column) -> Column:
    ratio = relevant / F.greatest(total, F.lit(1))
    return (
        F.when(ratio >= 0.6, "generate")
        .when((ratio > 0) & (ambiguous > 0), "decompose")
        .when(ratio > 0, "filter_and_supplement")
        .otherwise("rewrite")
    )
