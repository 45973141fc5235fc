"""Invoice, order-matching, tax, contract, template and page-layout rules."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import patterns as P
from leafmill.functions import text as X
from leafmill.operators.matching import GROUP_ROWS, assign_in_order, by_size, gathered, rare_first, similar_bags, walked
from leafmill.sources.scratch import written

# Invoice and order-matching limits.
DEVIATION_HIGH, DEVIATION_CRITICAL, ROUND_MIN, MISSING_PO_MIN, MAX_AGE_DAYS = 0.10, 0.25, 1000, 1000, 90
PRICE_TOLERANCE, DESCRIPTION_MATCH = 0.05, 0.85


def duplicate_invoices(inv: DataFrame) -> DataFrame:
    """Invoices that repeat a number (critical) or vendor, date and amount within a cent (high).

    inv(file, number, vendor, amount, date). Each invoice is compared with grouped counts of its number and of
    its own and neighbouring cent buckets, so copies are never paired with each other.
    """
    inv = inv.withColumns({"_v": F.lower("vendor"), "_b": F.floor(F.col("amount") * 100)})
    numbers = inv.where("number is not null").groupBy("number").agg(F.count("*").alias("_n"), F.min("file").alias("_f1"), F.max("file").alias("_f2"))
    buckets = inv.groupBy("_v", "date", "_b").agg(F.count("*").alias("_c"), F.min("amount").alias("_lo"), F.max("amount").alias("_hi"))
    below = buckets.select("_v", "date", (F.col("_b") + 1).alias("_b"), F.col("_hi").alias("_below"))
    above = buckets.select("_v", "date", (F.col("_b") - 1).alias("_b"), F.col("_lo").alias("_above"))
    j = (
        inv.join(numbers, "number", "left")
        .join(buckets.select("_v", "date", "_b", "_c"), ["_v", "date", "_b"], "left")
        .join(below, ["_v", "date", "_b"], "left")
        .join(above, ["_v", "date", "_b"], "left")
    )
    same = F.coalesce(F.col("_n") > 1, F.lit(False))
    near = (
        F.coalesce(F.col("_c") > 1, F.lit(False))
        | F.coalesce(F.col("amount") - F.col("_below") < 0.01, F.lit(False))
        | F.coalesce(F.col("_above") - F.col("amount") < 0.01, F.lit(False))
    )
    return j.where(same | near).select(
        "file",
        "number",
        F.when(same, "critical").otherwise("high").alias("severity"),
        F.when(same, F.when(F.col("_f1") == F.col("file"), F.col("_f2")).otherwise(F.col("_f1"))).alias("duplicate_file"),
    )


def invoice_anomalies(inv: DataFrame, as_of: Column) -> DataFrame:
    """Row rules of one invoice scan; ``inv`` also has expected, po_number, due_date and n_lines."""

    def hit(cond: Column, kind: str, sev: Column) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("anomaly"), sev.alias("severity")))

    dev = F.abs(F.col("amount") - F.col("expected")) / F.col("expected")
    usable = (F.col("expected") > 0) & (F.col("amount") > 0)
    rules = F.array_compact(
        F.array(
            hit(usable & (dev > DEVIATION_HIGH), "amount_deviation", F.when(dev > DEVIATION_CRITICAL, "critical").otherwise("high")),
            hit((F.coalesce("po_number", F.lit("")) == "") & (F.col("amount") > MISSING_PO_MIN), "missing_po", F.lit("medium")),
            hit(F.datediff(as_of, F.col("date")) > MAX_AGE_DAYS, "old_invoice", F.lit("medium")),
            hit(F.col("due_date") < F.col("date"), "due_before_date", F.lit("high")),
            hit((F.col("amount") >= ROUND_MIN) & (F.col("amount") % 100 == 0) & (F.col("n_lines") <= 1), "round_number", F.lit("low")),
        )
    )
    rows = inv.select("file", F.explode(rules).alias("r")).select("file", "r.*")
    dups = duplicate_invoices(inv.select("file", "number", "vendor", "amount", "date"))
    return rows.unionByName(dups.select("file", F.lit("duplicate").alias("anomaly"), "severity"))


def invoice_complete() -> Column:
    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string") != "", F.lit(False))

    return filled("number") & filled("date") & filled("vendor") & F.coalesce(F.col("amount") > 0, F.lit(False))


def sku_of(text: Column) -> Column:
    return F.upper(F.regexp_extract(text, r"(?i)(?:SKU|Part|PN|Item)#?\s*([A-Z0-9\-]{3,})", 1))


def token_score(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(X.split_space(F.lower(a))), F.array_distinct(X.split_space(F.lower(b)))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y), F.lit(1))


def po_match(lines: DataFrame, po: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Match invoice lines to order lines, each order line once, in the order of the invoice lines.

    lines(invoice, inv_seq, inv_text, unit_price) and po(invoice, po_seq, po_text, po_price); ``seq`` columns are unique
    in their invoice. A line takes the free order line of the highest score: 1 for an equal SKU, else the share of common
    words where it reaches the threshold; the first order line among equal ones. Prices are told apart by a tolerance.
    Invoices with more than ``group_rows`` lines or order lines are matched in rounds of joins.
    """
    small, large = by_size(lines, po, "invoice", group_rows)
    found = _po_short(*small)
    out = found if large is None else found.unionByName(_po_long(*large))
    gap = F.abs(F.col("unit_price") - F.col("po_price")) > PRICE_TOLERANCE * F.col("po_price")
    return out.select(
        "invoice",
        "inv_seq",
        "po_seq",
        F.coalesce("match", F.lit("none")).alias("match"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.when(F.col("match").isNotNull(), F.coalesce((F.col("po_price") > 0) & gap, F.lit(False))).alias("price_mismatch"),
    )


def _po_short(lines: DataFrame, po: DataFrame) -> DataFrame:
    """Each invoice in one row."""

    def side(*cols: str) -> Column:
        text = F.coalesce("text", F.lit(""))
        return F.struct(*cols, sku_of(text).alias("sku"), F.array_distinct(X.split_space(F.lower(text))).alias("words"))

    def score(x: Column, u: Column) -> Column:
        common = F.size(F.array_intersect(x["words"], u["words"])) / F.greatest(F.size(x["words"]), F.size(u["words"]), F.lit(1))
        return F.when((x["sku"] != "") & (x["sku"] == u["sku"]), F.lit(1.0)).when(common >= DESCRIPTION_MATCH, common)

    mine = lines.select("invoice", "inv_seq", "unit_price", F.col("inv_text").alias("text"))
    theirs = po.select("invoice", "po_seq", "po_price", F.col("po_text").alias("text"))
    g = gathered(mine, theirs, "invoice", lambda: side("inv_seq", "unit_price"), lambda: side("po_seq", "po_price"))
    got = walked(F.col("lines"), F.col("units"), score, g.schema["units"].dataType.elementType.simpleString())
    r = g.select("invoice", F.explode(F.arrays_zip(F.col("lines").alias("line"), got.alias("got"))).alias("r")).select("invoice", "r.*")
    sku = F.col("line.sku")
    match = F.when(F.col("got").isNotNull(), F.when((sku != "") & (sku == F.col("got.unit.sku")), "exact").otherwise("fuzzy"))
    return r.select(
        "invoice", "line.inv_seq", "line.unit_price", "got.unit.po_seq", "got.unit.po_price", match.alias("match"), "got.score"
    )


def _po_long(lines: DataFrame, po: DataFrame) -> DataFrame:
    """Any invoice, by joins of distinct texts and rounds of choices."""
    said = lambda c: F.coalesce(F.col(c), F.lit("")).alias("text")
    # Each text is taken apart once, however many lines repeat it.
    texts = lines.select(said("inv_text")).unionByName(po.select(said("po_text"))).distinct()
    words = F.array_sort(F.array_distinct(X.split_space(F.lower("text"))))
    parsed = written(texts.select("text", sku_of(F.col("text")).alias("sku"), words.alias("words")).withColumn("bag", F.xxhash64("words")))
    few = rare_first(parsed.select("bag", "words").dropDuplicates(["bag"]), DESCRIPTION_MATCH)
    parsed = written(parsed.drop("words").join(few, "bag", "left"))

    def sides(df: DataFrame, text: str, *cols: str) -> DataFrame:
        t = df.select(F.col("invoice").alias("group"), *cols, said(text)).join(parsed.select("text", "bag", "sku"), "text")
        return written(t.drop("text").withColumn("cls", F.xxhash64("sku", F.lit("|"), "bag")))

    def classes(side: DataFrame, cls: str) -> DataFrame:
        known = parsed.select("bag", "words", "few").dropDuplicates(["bag"])
        return side.select("group", F.col("cls").alias(cls), "sku", "bag").distinct().join(known, "bag")

    a, b = sides(lines, "inv_text", "inv_seq", "unit_price"), sides(po, "po_text", "po_seq", "po_price")
    mine, theirs = classes(a, "cls"), classes(b, "ucls")
    exact = mine.where("sku <> ''").join(theirs.select("group", "ucls", "sku"), ["group", "sku"])
    exact = exact.select("group", "cls", "ucls", F.lit(1.0).alias("score"), F.lit("exact").alias("match"))
    fuzzy = similar_bags(mine, theirs, DESCRIPTION_MATCH)
    both = exact.unionByName(fuzzy.withColumn("match", F.lit("fuzzy")))
    choices = written(both.groupBy("group", "cls", "ucls").agg(F.max("score").alias("score"), F.min("match").alias("match")))
    got = assign_in_order(
        a.select("group", "cls", F.col("inv_seq").alias("seq")),
        b.select("group", F.col("cls").alias("ucls"), F.col("po_seq").alias("useq")),
        choices,
    )
    named = got.withColumnsRenamed({"seq": "inv_seq", "useq": "po_seq"}).join(
        b.select("group", "po_seq", "po_price", F.col("cls").alias("ucls")), ["group", "po_seq"]
    )
    out = a.select("group", "cls", "inv_seq", "unit_price").join(named, ["group", "inv_seq"], "left").join(
        choices, ["group", "cls", "ucls"], "left"
    )
    return out.select(F.col("group").alias("invoice"), "inv_seq", "unit_price", "po_seq", "po_price", "match", "score")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two struct(x1, y1, x2, y2)."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))

    def area(r: Column) -> Column:
        return (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])

    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def iou_pairs(a: DataFrame, b: DataFrame, threshold: float = 0.5, cell: float = 64.0) -> DataFrame:
    """Overlapping boxes of one page. A box pair meets in the cell of its intersection's corner only.

    a and b: (page, id, box struct, ...).
    """

    def cells(df: DataFrame, id_: str, box: str) -> DataFrame:
        def span(lo: str, hi: str) -> Column:
            return F.sequence(F.floor(F.col(f"box.{lo}") / cell), F.floor(F.col(f"box.{hi}") / cell))

        cx = df.select("page", F.col("id").alias(id_), F.col("box").alias(box), F.explode(span("x1", "x2")).alias("_cx"), "box")
        return cx.withColumn("_cy", F.explode(span("y1", "y2"))).drop("box")

    p = cells(a, "id_a", "box_a").join(cells(b, "id_b", "box_b"), ["page", "_cx", "_cy"])
    corner = (F.col("_cx") == F.floor(F.greatest("box_a.x1", "box_b.x1") / cell)) & (
        F.col("_cy") == F.floor(F.greatest("box_a.y1", "box_b.y1") / cell)
    )
    scored = p.where(corner).withColumn("iou", iou(F.col("box_a"), F.col("box_b")))
    return scored.where(F.col("iou") > threshold).select("page", "id_a", "id_b", "iou")


def matched_boxes(a: DataFrame, b: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(page, id_a, id_b)``: the boxes of ``a`` choose by line, each the free box of ``b`` that overlaps it most."""
    pairs = written(iou_pairs(a, b, threshold))
    return assign_in_order(
        a.select(F.col("page").alias("group"), F.col("id").alias("cls"), F.struct("line", "id").alias("seq")),
        b.select(F.col("page").alias("group"), F.col("id").alias("ucls"), F.struct("line", "id").alias("useq")),
        pairs.select(F.col("page").alias("group"), F.col("id_a").alias("cls"), F.col("id_b").alias("ucls"), F.col("iou").alias("score")),
    ).select(F.col("group").alias("page"), F.col("seq.id").alias("id_a"), F.col("useq.id").alias("id_b"))


@F.pandas_udf(T.DoubleType())
def closest_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Highest similarity of a text to any of the given texts."""
    for text, others in batches:
        yield pd.Series(
            [max((SequenceMatcher(None, x, y).ratio() for y in ys), default=0.0) for x, ys in zip(text, others)], dtype="float64"
        )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def closest_texts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """For each of the texts, its highest similarity to any of the others; null for null."""

    def best(x: str, others) -> float:
        return max((SequenceMatcher(None, x, y).ratio() for y in others), default=0.0)

    for texts, others in batches:
        yield pd.Series([None if xs is None else [best(x, ys) for x in xs] for xs, ys in zip(texts, others)], dtype="object")


def iou_block_merge(
    a: DataFrame, b: DataFrame, threshold: float = 0.5, similar: float = 0.95, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """One block list per page from two readings (page, id, box, line, text, confidence).

    Boxes of ``a`` choose in line order, each box of ``b`` once, and pairs keep the surer text; unmatched boxes of b are added unless
    some text of a on the page is nearly the same. Only such leftovers reach Python. Pages with more than ``group_rows``
    boxes on a side are matched in rounds of joins.
    """
    small, large = by_size(a, b, "page", group_rows)
    found = _merge_short(*small, threshold, similar)
    return found if large is None else found.unionByName(_merge_long(*large, threshold, similar))


def _merge_short(a: DataFrame, b: DataFrame, threshold: float, similar: float) -> DataFrame:
    """Each page in one row."""
    cols = ["line", "id", "text", "confidence", "box"]

    def score(x: Column, u: Column) -> Column:
        p, q, s = x["box"], u["box"], iou(x["box"], u["box"])
        meet = (p["x1"] < q["x2"]) & (q["x1"] < p["x2"]) & (p["y1"] < q["y2"]) & (q["y1"] < p["y2"])
        return F.when(meet & (s > threshold), s)

    def block(x: Column, side: str) -> Column:
        return F.struct(x["line"].alias("line"), F.lit(side).alias("side"), x["id"].alias("id"), x["text"].alias("text"), x["confidence"].alias("confidence"))

    g = gathered(a.select("page", *cols), b.select("page", *cols), "page", lambda: F.struct(*cols), lambda: F.struct(*cols))
    got = walked(F.col("lines"), F.col("units"), score, g.schema["units"].dataType.elementType.simpleString())
    g = g.select("page", "lines", "units", got.alias("got"))
    surer = lambda x, y: F.when(y["unit"]["confidence"] > x["confidence"], block(y["unit"], "b")).otherwise(block(x, "a"))
    used = F.transform("got", lambda y: y["at"])
    rest = F.filter("units", lambda u, i: ~F.coalesce(F.array_contains(used, -i), F.lit(False)))
    texts = F.array_compact(F.transform("lines", lambda x: x["text"]))
    rest = F.filter(rest, lambda u: u["text"].isNotNull() & ~F.array_contains(texts, u["text"]))
    g = g.select("page", F.zip_with("lines", "got", surer).alias("kept"), F.transform(rest, lambda u: block(u, "b")).alias("rest"), texts.alias("texts"))
    some = F.size("rest") > 0
    near = closest_texts(F.when(some, F.transform("rest", lambda u: u["text"])), F.when(some, F.array_distinct("texts")))
    g = g.select("page", "kept", "rest", near.alias("near"))
    added = F.filter("rest", lambda u, i: F.get("near", i) <= similar)
    blocks = F.array_sort(F.concat("kept", F.when(F.size("rest") > 0, added).otherwise(F.col("rest"))))
    return g.select("page", F.posexplode(blocks).alias("seq", "r")).select("page", "r.line", "r.side", "r.id", "r.text", "r.confidence", "seq")


def _merge_long(a: DataFrame, b: DataFrame, threshold: float, similar: float) -> DataFrame:
    """Any page, by grid cells and rounds of choices."""
    cols = ["page", "line", "side", "id", "text", "confidence"]
    matched = matched_boxes(a, b, threshold)
    other = b.select("page", F.col("id").alias("id_b"), F.struct("line", F.lit("b").alias("side"), "id", "text", "confidence").alias("_b"))
    mine = a.select("page", F.col("id").alias("id_a"), F.struct("line", F.lit("a").alias("side"), "id", "text", "confidence").alias("_a"))
    pairs = matched.join(other, ["page", "id_b"])
    kept = mine.join(pairs, ["page", "id_a"], "left").select(
        "page", F.when(F.col("_b.confidence") > F.col("_a.confidence"), F.col("_b")).otherwise(F.col("_a")).alias("r")
    ).select("page", "r.*")
    texts = a.groupBy("page").agg(F.collect_set("text").alias("_texts"))
    rest = (
        b.select("page", "line", F.lit("b").alias("side"), "id", "text", "confidence")
        .join(matched.select("page", F.col("id_b").alias("id")), ["page", "id"], "left_anti")
        .join(texts, "page", "left")
        .where(~F.coalesce(F.array_contains("_texts", F.col("text")), F.lit(False)))
        .where(closest_text("text", F.coalesce("_texts", F.array().cast("array<string>"))) <= similar)
    )
    order = W.partitionBy("page").orderBy("line", "side", "id")
    return kept.select(*cols).unionByName(rest.select(*cols)).withColumn("seq", F.row_number().over(order) - 1)


def gst_checks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Line and party rules: GSTIN shape and state, tax more than 1.0 off, missing HSN."""
    state = F.substring("gstin", 1, 2).try_cast("int")
    valid = F.col("gstin").rlike(r"^\d{2}[A-Z]{5}\d{4}[A-Z][A-Z\d]Z[A-Z\d]$") & state.between(1, 38)
    expected = F.round(F.col("taxable") * F.col("rate") / 100, 2)
    hits = F.array_compact(
        F.array(
            F.when((F.coalesce("gstin", F.lit("")) != "") & ~F.coalesce(valid, F.lit(False)), F.struct(F.lit("gstin_invalid").alias("type"), F.lit("high").alias("severity"))),
            F.when((F.col("taxable") > 0) & (F.col("rate") > 0) & (F.abs(F.col("tax") - expected) > 1.0), F.struct(F.lit("tax_calculation_error").alias("type"), F.lit("high").alias("severity"))),
            F.when(F.coalesce("hsn", F.lit("")) == "", F.struct(F.lit("missing_hsn").alias("type"), F.lit("medium").alias("severity"))),
        )
    )
    return lines.select(*keys, F.explode(hits).alias("h")).select(*keys, "h.*")


def gst_split(amount: Column, seller: Column, buyer: Column, rate: float = 0.18) -> dict[str, Column]:
    gst = F.bround(amount * rate, 2)
    same = seller == buyer
    half = F.when(same, F.bround(gst / 2, 2)).otherwise(0.0)
    return {
        "cgst": half,
        "sgst": half,
        "igst": F.when(same, 0.0).otherwise(gst),
        "total_gst": gst,
        "total": F.bround(amount + gst, 2),
    }


def bbox_normalise(points: Column) -> Column:
    """Four corner points from 4 points, 2 points or 4 numbers (given as array<array<double>>), else a default box."""

    def corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        return F.array(F.array(x1, y1), F.array(x2, y1), F.array(x2, y2), F.array(x1, y2))

    def at(i: int, j: int) -> Column:
        return F.get(F.get(points, F.lit(i)), F.lit(j))

    pairs = F.forall(points, lambda p: F.size(p) == 2)
    singles = F.forall(points, lambda p: F.size(p) == 1)
    default = corners(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(100.0))
    return F.coalesce(
        F.when((F.size(points) == 4) & pairs, points)
        .when((F.size(points) == 4) & singles, corners(at(0, 0), at(1, 0), at(2, 0), at(3, 0)))
        .when((F.size(points) == 2) & pairs, corners(at(0, 0), at(0, 1), at(1, 0), at(1, 1)))
        .otherwise(default),
        default,
    )


def template_check(values: DataFrame, keys: list[str], template: list[tuple[str, str, bool]], low: float = 0.5) -> DataFrame:
    """Problems per field of values(keys..., field, value, confidence): missing required, wrong type, low confidence."""
    spec = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(ty).alias("type"), F.lit(rq).alias("required")) for f, ty, rq in template])
    wanted = values.select(*keys).distinct().select(*keys, F.explode(spec).alias("s")).select(*keys, "s.*")
    j = wanted.join(values, [*keys, "field"], "left")
    blank = F.coalesce(F.trim("value"), F.lit("")) == ""
    bad = F.when(F.col("type") == "number", F.col("value").try_cast("double").isNull()).when(
        F.col("type") == "date", F.col("value").try_cast("date").isNull()
    ).otherwise(F.lit(False))
    problem = (
        F.when(blank & F.col("required"), "missing_required")
        .when(~blank & bad, "bad_type")
        .when(~blank & (F.col("confidence") < low), "low_confidence")
    )
    return j.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(*keys, "field", "problem")


# Words that give a clause its type; the first match counts. A verdict table can replace this typer.
CLAUSE_WORDS = (
    ("liability", "liability_cap"),
    ("indemnif", "indemnification"),
    ("terminat", "termination"),
    ("payment", "payment_terms"),
    ("intellectual", "intellectual_property"),
    ("confidential", "confidentiality"),
    ("governing law", "governing_law"),
    ("dispute", "dispute_resolution"),
    ("force majeure", "force_majeure"),
    ("warrant", "warranty"),
    ("remed", "limitation_of_remedies"),
    ("assign", "assignment"),
    ("amend", "amendment"),
    ("entire agreement", "entire_agreement"),
)


def clause_type(title: Column) -> Column:
    out, low = F.lit("other"), F.lower(title)
    for word, kind in reversed(CLAUSE_WORDS):
        out = F.when(F.contains(low, F.lit(word)), kind).otherwise(out)
    return out


def clauses(chunks: DataFrame, key: str, index: str, text: str, per_group: int = 3) -> DataFrame:
    """Clause titles of every ``per_group`` consecutive chunks, typed by keyword.

    ``clause_text`` runs from the title to the next title of the same pattern order found after it, or to the end.
    """
    g = chunks.withColumn("grp", F.floor(F.col(index) / per_group))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(index, text))), lambda s: s[text]), "\n\n")
    batches = g.groupBy(key, "grp").agg(joined.alias("_t"))
    titles = batches.select(key, "grp", "_t", X.clause_headings(F.col("_t")).alias("_titles"))
    found = titles.select(key, "grp", "_t", "_titles", F.posexplode("_titles").alias("pos", "title"))
    start = F.instr("_t", F.col("title"))
    later = F.filter(F.transform("_titles", lambda t: F.call_function("instr", F.col("_t"), t)), lambda p: p > F.col("_start"))
    end = F.coalesce(F.array_min(later), F.length("_t") + 1)
    placed = found.withColumn("_start", start).withColumn("_end", end)
    body = F.substring(F.col("_t"), F.col("_start"), F.col("_end") - F.col("_start"))
    return placed.select(key, "grp", "pos", clause_type(F.col("title")).alias("clause_type"), "title", body.alias("clause_text"))


# Clause weights.
CLAUSE_WEIGHTS = {"liability_cap": 20, "indemnification": 20, "termination": 15, "payment_terms": 15, "governing_law": 12}


def risk_rollup(cl: DataFrame, key: str) -> DataFrame:
    """Weighted contract risk with a penalty per missing standard clause; sums and flags only."""
    s = F.greatest(F.lit(1.0), F.least(F.lit(10.0), F.coalesce("risk_score", F.lit(5.0))))
    w = F.lit(10)
    for kind, weight in CLAUSE_WEIGHTS.items():
        w = F.when(F.col("clause_type") == kind, weight).otherwise(w)
    present = sum((F.max((F.col("clause_type") == c).cast("int")) for c in P.STANDARD_CLAUSES), F.lit(0))
    base = cl.withColumns({"_s": s, "_w": w}).groupBy(key).agg(
        F.count("clause_type").alias("n_clauses"),
        (F.sum(F.col("_s") * F.col("_w")) / F.sum("_w")).alias("_base"),
        (F.lit(len(P.STANDARD_CLAUSES)) - F.coalesce(present, F.lit(0))).cast("bigint").alias("n_missing"),
        F.count_if((F.col("_s") >= 9) & F.col("clause_type").isNotNull()).alias("n_critical"),
        F.count_if((F.col("_s") >= 7) & (F.col("_s") < 9) & F.col("clause_type").isNotNull()).alias("n_high"),
    )
    score = F.least(F.lit(10.0), F.when(F.col("n_clauses") > 0, F.col("_base")).otherwise(5.0) + F.col("n_missing") * 0.5)
    r = base.withColumn("risk", F.round(score, 6)).drop("_base")
    level = F.when(F.col("risk") >= 7.5, "critical").when(F.col("risk") >= 5.5, "high").when(F.col("risk") >= 3.5, "medium").otherwise("low")
    return r.withColumn("level", level)


def missing_clauses(cl: DataFrame, key: str) -> DataFrame:
    std = F.array(*[F.lit(c) for c in P.STANDARD_CLAUSES])
    return cl.groupBy(key).agg(F.array_except(std, F.collect_set("clause_type")).alias("missing"))


def obligations(chunks: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Sentences that hold an obligation word, from chunks that pass the keyword gate."""
    gate = chunks.where(X.contains_any(F.col(text), P.OBLIGATION_WORDS))
    s = F.filter(X.sentences(F.col(text)), lambda x: X.contains_any(x, P.OBLIGATION_WORDS))
    rows = gate.select(*keys, F.posexplode(s).alias("pos", "_s"))
    party = F.regexp_extract("_s", r"^((?:The )?[A-Z][\w]*)", 1)
    return rows.select(*keys, "pos", party.alias("party"), F.col("_s").alias("obligation"))


CODE_SHAPE = r"\b[A-TV-Z][0-9][0-9A-B](?:\.[0-9A-TV-Z]{1,4})?\b"


def clinical_codes(chunks: DataFrame, doc: str, index: str, text: str) -> DataFrame:
    """Code-shaped strings of clinical chunks, first occurrence per document."""
    gate = chunks.where(X.contains_any(F.col(text), P.CLINICAL_WORDS))
    hits = gate.select(doc, index, text, F.posexplode(F.regexp_extract_all(text, F.lit(CODE_SHAPE), F.lit(0))).alias("pos", "code"))
    first = F.min(F.struct(index, "pos", F.col(text).alias("evidence")))
    return hits.groupBy(doc, "code").agg(first.alias("f")).select(doc, "code", f"f.{index}", "f.evidence", F.lit(0.8).alias("confidence"))


def invoice_from_fields(rows: DataFrame, key: str, js: str) -> DataFrame:
    """Typed invoice header from extracted JSON: defaults, line items with a description, filled share."""
    schema = (
        "invoice_number string, invoice_date string, vendor_name string, po_number string, currency string, "
        "tax_amount string, total_amount string, "
        "line_items array<struct<description:string, quantity:string, unit_price:string, total:string>>"
    )
    j = rows.select(key, F.from_json(X.lenient_json(F.col(js)), schema).alias("j"))

    def num(c: Column, default: float) -> Column:
        return F.coalesce(c.try_cast("double"), F.lit(default))

    filled = sum(
        (F.coalesce((F.col(f"j.{f}") != "") & (F.col(f"j.{f}") != "0"), F.lit(False)).cast("int") for f in ("invoice_number", "invoice_date", "vendor_name", "total_amount")),
        F.lit(0),
    )
    items = F.filter(F.coalesce(F.col("j.line_items"), F.array().cast("array<struct<description:string,quantity:string,unit_price:string,total:string>>")), lambda x: F.coalesce(x["description"] != "", F.lit(False)))
    return j.select(
        key,
        "j.invoice_number",
        "j.vendor_name",
        F.coalesce("j.currency", F.lit("USD")).alias("currency"),
        num(F.col("j.tax_amount"), 0.0).alias("tax_amount"),
        num(F.col("j.total_amount"), 0.0).alias("total_amount"),
        F.size(items).alias("n_items"),
        F.aggregate(items, F.lit(0.0), lambda a, x: a + num(x["quantity"], 1.0) * num(x["unit_price"], 0.0)).alias("items_total"),
        (filled / 4).alias("confidence"),
    )
