import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import graph as G
from leafmill.operators import joins as J
from leafmill.operators import rules as R


def test_po_match(spark):
    inv = [
        (1, "01", "SKU ABC123 steel bolt", 10.0), (1, "02", "red widget", 5.0), (1, "03", "widget red", 5.0), (1, "04", "one two three four five six seven", 1.0),
        (1, "05", "no partner", 1.0), (2, "01", "red widget", 5.0),
    ]
    po = [(1, "01", "part# abc123", 10.2), (1, "02", "Red Widget", 9.0), (1, "03", "one two three four five six eight", 1.0), (1, "04", "one two three four five six seven eight", 1.0)]
    got = R.po_match(
        spark.createDataFrame(inv, "invoice int, inv_seq string, inv_text string, unit_price double"),
        spark.createDataFrame(po, "invoice int, po_seq string, po_text string, po_price double"),
    ).collect()
    m = {(r["invoice"], r["inv_seq"]): (r["po_seq"], r["match"], r["price_mismatch"]) for r in got}
    assert len(got) == 6
    assert m[(1, "01")] == ("01", "exact", False) and m[(1, "02")] == ("02", "fuzzy", True)
    assert m[(1, "03")] == (None, "none", None) and m[(1, "04")] == ("04", "fuzzy", False) and m[(2, "01")][1] == "none"


def test_duplicates_without_pairs(spark):
    rows = [(i, f"N{i}", "Acme", 10.0, "2024-01-01") for i in range(300)]
    rows += [(900, "X", "b", 5.004, "d"), (901, "Y", "B", 5.012, "d"), (902, "Z", "b", 5.03, "d"), (903, "S", "q", 1.0, "e"), (904, "S", "r", 2.0, "f"), (905, None, "s", 3.0, "g")]
    got = {r["file"]: r["severity"] for r in R.duplicate_invoices(spark.createDataFrame(rows, "file int, number string, vendor string, amount double, date string")).collect()}
    assert sum(f < 300 for f in got) == 300 and set(got.values()) == {"high", "critical"}
    assert got[900] == got[901] == "high" and 902 not in got and got[903] == got[904] == "critical" and 905 not in got


def test_iou_merge_against_brute_force(spark):
    rnd = random.Random(4)

    def boxes(n, jitter):
        out = []
        for p in range(4):
            for i in range(n):
                x, y = (i % 3) * 30 + rnd.random() * jitter, (i // 3) * 12 + rnd.random() * jitter
                out.append((p, i, (x, y, x + 40.0, y + 15.0), i, f"{rnd.choice('abcdef') * 9} {i}", rnd.random()))
        return out

    a, b = boxes(9, 3), boxes(9, 9)
    schema = "page int, id int, box struct<x1:double,y1:double,x2:double,y2:double>, line int, text string, confidence double"
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)

    def iou(p, q):
        w = max(0, min(p[2], q[2]) - max(p[0], q[0]))
        h = max(0, min(p[3], q[3]) - max(p[1], q[1]))
        return w * h / (600 * 2 - w * h)

    pairs = sorted((-iou(x[2], y[2]), x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and iou(x[2], y[2]) > 0.5)
    got = R.iou_pairs(da, db, cell=16.0).collect()
    assert sorted((r["page"], r["id_a"], r["id_b"]) for r in got) == sorted(p[1:] for p in pairs)
    ub, chosen = set(), []
    for p, i in sorted({(p, i) for _, p, i, _ in pairs}):  # boxes of a choose by line
        for _, _, _, j in [x for x in pairs if x[1:3] == (p, i)]:
            if (p, j) not in ub:
                ub.add((p, j))
                chosen.append((p, i, j))
                break
    assert sorted(map(tuple, R.matched_boxes(da, db).collect())) == sorted(chosen)
    merged = R.iou_block_merge(da, db).collect()
    conf_a, conf_b = {(r[0], r[1]): r[5] for r in a}, {(r[0], r[1]): r[5] for r in b}
    kept = {(r["page"], r["side"], r["id"]) for r in merged}
    for p, i, j in chosen:
        want = ("b", j) if conf_b[(p, j)] > conf_a[(p, i)] else ("a", i)
        assert (p, *want) in kept and len({(p, "a", i), (p, "b", j)} & kept) == 1


def test_interactions(spark):
    meds = spark.createDataFrame([(1, "Aspirin"), (1, "warfarin "), (1, "ASPIRIN"), (2, "aspirin"), (3, "")], "patient_id int, name string")
    known = spark.createDataFrame([("warfarin", "aspirin", "major"), ("x", "aspirin", None)], "drug_1 string, drug_2 string, severity string")
    assert [(r["patient_id"], r["severity"]) for r in J.interaction_matches(meds, known).collect()] == [(1, "major")]


def test_acl(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "web:x"), (4, None)], "doc_id int, source string")
    acl = spark.createDataFrame([(2, "u1"), (2, "u2"), (3, "u9"), (4, "u9"), (1, "u9")], "doc_id int, grantee string")
    assert sorted(r["doc_id"] for r in J.acl_visible(docs, acl, F.lit("u1")).collect()) == [2, 3, 4]


def test_paths_no_repeated_edge(spark):
    e = spark.createDataFrame([("a", "b", "x"), ("b", "a", "x"), ("b", "c", "y"), ("c", "b", "z")], "src string, dst string, type string")
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id string")
    got = {r["path"]: r["hops"] for r in G.paths(e, ids("a"), ids("b", "c"), 3).collect()}
    assert got == {"a>b": 1, "a>b>c": 2, "a>b>c>b": 3}


def test_paths_against_brute_force(spark):
    import random

    rng = random.Random(4)
    edges = sorted({(f"v{rng.randrange(12)}", f"v{rng.randrange(12)}", rng.choice("xy")) for _ in range(26)})
    sources, targets = ["v0", "v1", "v5", "alone"], ["v2", "v5", "v9"]
    want, front = [], [(s, s, s, "", ()) for s in sources]
    for _ in range(4):
        front = [
            (start, d, f"{path}>{d}", f"{rels}>{t}" if rels else t, (*used, (s, d, t)))
            for start, end, path, rels, used in front
            for s, d, t in edges
            if s == end and (s, d, t) not in used
        ]
        want += [(start, end, len(used), path, rels) for start, end, path, rels, used in front if end in targets]
    ids = lambda vs: spark.createDataFrame([(x,) for x in vs], "id string")
    got = G.paths(spark.createDataFrame(edges, "src string, dst string, type string"), ids(sources), ids(targets), 4)
    assert len(want) > 20 and sorted(map(tuple, got.collect())) == sorted(want)


def test_entity_clean_caps(spark):
    ents = spark.createDataFrame([(1, i, n, t) for i, (n, t) in enumerate([("A", "x"), (" ", "x"), ("A", "y"), ("B", "z")])], "chunk int, ord int, name string, type string")
    rels = spark.createDataFrame([(1, 0, "A", "B", "r"), (1, 1, "A", "Q", "r")], "chunk int, ord int, src string, dst string, type string")
    e, r = G.entity_clean(ents, rels)
    assert {(x["name"], x["type"]) for x in e.collect()} == {("A", "y"), ("B", "z")} and r.count() == 1
    assert G.entity_clean(ents, rels, max_entities=1)[0].count() == 1


def test_bbox(spark):
    rows = [([[0.0, 0.0], [4.0, 3.0]],), ([[1.0], [2.0], [3.0], [4.0]],), ([[1.0, 2.0, 3.0]],), (None,)]
    got = [r["b"] for r in spark.createDataFrame(rows, "p array<array<double>>").select(R.bbox_normalise(F.col("p")).alias("b")).collect()]
    assert got[0] == [[0, 0], [4, 0], [4, 3], [0, 3]] and got[1][2] == [3, 4] and got[2] == got[3] == [[0, 0], [100, 0], [100, 100], [0, 100]]


@pytest.mark.parametrize("seller,buyer,want", [(29, 29, (9.0, 9.0, 0.0)), (29, 7, (0.0, 0.0, 18.0))])
def test_gst_split(spark, seller, buyer, want):
    s = R.gst_split(F.lit(100.0), F.lit(seller), F.lit(buyer))
    r = spark.range(1).select(*[c.alias(n) for n, c in s.items()]).first()
    assert (r["cgst"], r["sgst"], r["igst"]) == want and r["total"] == 118.0


def test_fuzzy_order_lines_of_six_words(spark):
    lines = spark.createDataFrame([(1, "1", "a b c d e f", 1.0), (1, "2", "p q r s t", 1.0)], "invoice int, inv_seq string, inv_text string, unit_price double")
    po = spark.createDataFrame([(1, "1", "a b c d e f g", 1.0), (1, "2", "p q r s t u", 1.0)], "invoice int, po_seq string, po_text string, po_price double")
    got = {r["inv_seq"]: (r["po_seq"], r["match"], round(r["score"], 3)) for r in R.po_match(lines, po).collect()}
    assert got == {"1": ("1", "fuzzy", 0.857), "2": (None, "none", 0.0)}


def test_limits_are_honoured_or_refused(spark):
    from leafmill.operators import ranking

    df = spark.range(300).selectExpr("id", "id * 1.0D as v")
    assert ranking.top_k(df, "v", "id", 250).count() == 250
    assert ranking.page(df, ["id"], 200, 50).count() == 200
    for bad in (lambda: ranking.top_k(df, "v", "id", 0), lambda: ranking.page(df, ["id"], 5, -1)):
        with pytest.raises(ValueError):
            bad()


def test_cache_replay_is_not_renewed_by_hits(spark):
    from leafmill.operators.ranking import cached_replay

    rows = [(1, "k", 0, False), (2, "k", 10, True), (3, "k", 1000, True), (4, "k", 1811, True), (5, "k", 1900, False), (6, "j", 1900, True)]
    df = spark.createDataFrame(rows, "id int, key string, s int, ok boolean").selectExpr("id", "key", "timestamp_seconds(s) as at", "ok")
    got = {r["id"]: r["hit"] for r in cached_replay(df, "key", "at", "ok", "id", 1800).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: True, 6: False}


def test_percentages_round_after_scaling(spark):
    from leafmill.operators import accounting as A

    usage = spark.createDataFrame([(1, 316791)], "user_id long, tokens long")
    budgets = spark.createDataFrame([(1, 18000)], "user_id long, budget long")
    assert A.budget_summary(usage, budgets, "user_id").first()["budget_pct"] == 1760.0


def test_clause_titles_are_ascii_words(spark):
    from leafmill.functions import text as X

    text = "Section 3: Den schüsch. 12.5 Den schüsch ö geösch word. xé7.1 Abcdefghi jk."
    got = spark.createDataFrame([(text,)], "t string").select(X.clause_headings(F.col("t")).alias("h")).first()["h"]
    assert got == ["Den schüsch", "Den sch", "Abcdefghi jk"]


def test_means_round_after_scaling(spark):
    import math

    from leafmill.operators.aggregates import tidy

    values = [i / 100_000 for i in range(60_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", tidy(F.col("v"), 4).alias("t"))
    assert all(r.t == math.floor(r.v * 10_000 + 0.5) / 10_000 for r in df.collect())


def test_yearly_change_rounds_after_scaling(spark):
    import math

    from leafmill.operators import aggregates as A

    half_up = lambda x: math.copysign(math.floor(abs(x) + 0.5), x)
    pairs = [(i, 100.0 + i / 8, 80.0 + i % 40) for i in range(4000)]
    cur = spark.createDataFrame([(i, c) for i, c, _ in pairs], "k long, value double")
    prev = spark.createDataFrame([(i, p) for i, _, p in pairs], "k long, value double")
    got = {r.k: r.change for r in A.year_over_year(cur, prev, "k").collect()}
    want = {i: "Same" if c == p else f"{half_up((c - p) / p * 100 * 100) / 100:.2f}%" for i, c, p in pairs}
    assert got == want


def test_small_and_baseless_changes_keep_their_sign(spark):
    from leafmill.operators import aggregates as A

    pairs = [(302128.95, 302130.98), (302130.98, 302128.95), (99.995, 100.0), (5.0, 0.0), (-5.0, 0.0), (0.0, 0.0), (0.0, 5.0), (-100.001, -100.0)]
    cur = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(pairs)], "k long, value double")
    prev = spark.createDataFrame([(i, p) for i, (_, p) in enumerate(pairs)], "k long, value double")
    got = {r.k: r.change for r in A.year_over_year(cur, prev, "k").collect()}
    assert [got[i] for i in range(len(pairs))] == ["-0.00%", "0.00%", "-0.00%", "inf%", "-inf%", "Same", "-100.00%", "0.00%"]
