import random

from leafmill.operators import matching as M
from leafmill.operators import rules as R


def walk(lines, po):
    """Line by line: the best free order line, the first among equal ones."""
    out = {}
    for inv in {x[0] for x in lines}:
        free = sorted(x for x in po if x[0] == inv)
        for _, seq, text, _ in sorted(x for x in lines if x[0] == inv):
            best = (0.0, None)
            for p in free:
                a, b = set(text.lower().split()), set(p[2].lower().split())
                sku = lambda w: next((y for x, y in zip(w, w[1:]) if x == "sku"), None)
                mine, theirs = sku(text.lower().split()), sku(p[2].lower().split())
                s = 1.0 if mine and mine == theirs else len(a & b) / max(len(a), len(b), 1)
                if s >= 0.85 and s > best[0]:
                    best = (s, p)
            if best[1]:
                free.remove(best[1])
            out[inv, seq] = (best[1][1] if best[1] else None, round(best[0], 9))
    return out


def run(spark, lines, po):
    got = R.po_match(
        spark.createDataFrame(lines, "invoice int, inv_seq string, inv_text string, unit_price double"),
        spark.createDataFrame(po, "invoice int, po_seq string, po_text string, po_price double"),
    ).collect()
    assert len(got) == len(lines)
    return {(r.invoice, r.inv_seq): (r.po_seq, round(r.score, 9)) for r in got}


def test_lines_choose_in_their_order(spark):
    """An earlier line takes an order line that a later one would fit better."""
    lines = [(1, "1", "a b c d e f g h", 1.0), (1, "2", "a b c d e f g i", 1.0)]
    assert run(spark, lines, [(1, "1", "a b c d e f g i", 1.0)]) == {(1, "1"): ("1", 0.875), (1, "2"): (None, 0.0)}


def test_against_a_walk(spark):
    rnd = random.Random(11)

    def text():
        words = [rnd.choice("ab") + str(i) for i in range(rnd.randint(6, 8))]
        return ("SKU " + rnd.choice(["AAA1", "BBB2"]) + " " if rnd.random() < 0.25 else "") + " ".join(words)

    lines, po = [], []
    for inv in range(25):
        lines += [(inv, f"{i:03d}", text(), 1.0) for i in range(rnd.randint(1, 30))]
        po += [(inv, f"{i:03d}", text(), 1.0) for i in range(rnd.randint(0, 30))]
    got = run(spark, lines, po)
    assert got == walk(lines, po) and sum(v[0] is not None for v in got.values()) > 60


def test_many_equal_lines_take_few_rounds(spark, monkeypatch):
    n, calls = 400, []
    keep = M.written
    monkeypatch.setattr(M, "written", lambda df, *a: calls.append(1) or keep(df, *a))
    lines = [(1, f"{i:04d}", "one two three four five six" if i % 2 else "one two three four five six seven", 1.0) for i in range(n)]
    po = [(1, f"{i:04d}", "one two three four five six", 1.0) for i in range(n // 2 + 40)]
    assert run(spark, lines, po) == walk(lines, po)
    assert len(calls) < 12  # both kinds of line prefer the same units in the same order


def test_short_and_long_invoices_agree(spark):
    """The rows do not tell whether an invoice was walked in one row or in rounds."""
    rnd = random.Random(5)
    text = lambda: rnd.choice([None, "", "SKU AAA1 ", "Part BBB2 "] + [""] * 9) and "SKU AAA1 x" or " ".join(rnd.choice("ab") + str(i) for i in range(rnd.randint(6, 8)))
    lines = [(inv, f"{i:03d}", text(), float(i % 3)) for inv in [*range(12), None] for i in range(rnd.randint(1, 12))]
    po = [(inv, f"{i:03d}", text(), float(i % 4)) for inv in [*range(3, 14), None] for i in range(rnd.randint(0, 12))]
    lines += [(20, "1", None, 1.0), (20, "2", "  ", 1.0)]
    po += [(20, "1", "", 1.0), (20, "2", None, 1.0)]
    one = spark.createDataFrame(lines, "invoice int, inv_seq string, inv_text string, unit_price double")
    two = spark.createDataFrame(po, "invoice int, po_seq string, po_text string, po_price double")
    got = [sorted(map(str, R.po_match(one, two, n).collect())) for n in (R.GROUP_ROWS, 6, 0)]
    assert len(got[0]) == len(lines) and got[0] == got[1] == got[2]


def test_short_groups_need_no_rounds(spark, monkeypatch):
    def rounds(*_):
        raise AssertionError("rounds of joins for a short invoice")

    monkeypatch.setattr(R, "assign_in_order", rounds)
    assert run(spark, [(1, "1", "a b c", 1.0), (2, "1", "a", 1.0)], [(1, "1", "a b c", 1.0)]) == {(1, "1"): ("1", 1.0), (2, "1"): (None, 0.0)}


def test_short_and_long_pages_agree(spark):
    rnd = random.Random(8)
    box = lambda: (lambda x, y: (x, y, x + 30.0, y + 20.0))(rnd.randrange(8) * 6.0, rnd.randrange(8) * 4.0)
    schema = "page int, id int, box struct<x1:double,y1:double,x2:double,y2:double>, line int, text string, confidence double"
    side = lambda pages: spark.createDataFrame(
        [(p, i, box(), rnd.randrange(5), rnd.choice(["part one", "part two", "another text", f"text {i}"]), rnd.random()) for p in pages for i in range(rnd.randint(1, 12))], schema
    )
    a, b = side(range(10)), side(range(2, 13))
    got = [sorted(map(str, R.iou_block_merge(a, b, group_rows=n).collect())) for n in (R.GROUP_ROWS, 6, 0)]
    assert len(got[0]) > 60 and got[0] == got[1] == got[2]
