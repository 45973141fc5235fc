import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafmill.operators import evaluation as E
from leafmill.operators import monitoring as M
from leafmill.operators import provenance as V


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


PAIRS = [("hello wörld", "hallo wörld"), ("", "abc"), ("abc", ""), ("", ""), ("a b c d", "a x c"), ("same  Text", "same text")]


def test_cer_wer(spark):
    rnd = random.Random(5)
    words = [f"w{i}é" for i in range(300)]
    rows = PAIRS + [(" ".join(rnd.choices(words, k=200)), " ".join(rnd.choices(words, k=180))) for _ in range(3)]
    df = spark.createDataFrame(rows, "p string, g string")
    for r in E.with_wer(E.with_cer(df, "p", "g"), "p", "g").collect():
        p, g = " ".join(r["p"].lower().split()), " ".join(r["g"].lower().split())
        want_c = min(1, distance(p, g) / len(g)) if g else float(bool(p))
        want_w = min(1, distance(p.split(), g.split()) / len(g.split())) if g else float(bool(p))
        assert r["cer"] == pytest.approx(want_c) and r["wer"] == pytest.approx(want_w)


def test_cer_of_long_texts(spark):
    """One measure for every length, whether the distance lies in a narrow band, a wide one or beyond."""
    for n, changed in ((900, 20), (900, 500), (700, 1400)):
        g = "abcdefghij" * n
        p = g.replace("a", "x", changed).replace("b", "é", max(0, changed - n))
        got = E.with_cer(spark.createDataFrame([(p, g)], "p string, g string"), "p", "g").first()["cer"]
        assert got == pytest.approx(min(n, changed) / len(g) + max(0, changed - n) / len(g))


def test_wer_of_many_distinct_words(spark):
    g = [f"w{i}" for i in range(60_000)]
    p = [*g[:100], "new", *g[101:-1]]
    got = E.with_wer(spark.createDataFrame([(" ".join(p), " ".join(g))], "p string, g string"), "p", "g").first()["wer"]
    assert got == pytest.approx(2 / 60_000)


def test_rouge_l_bleu(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "the cat lay on a mat"), (2, "x", "y")], "k int, h string, r string")
    got = {r["k"]: r["s"] for r in df.select("k", E.rouge_l(F.split("h", " "), F.split("r", " ")).alias("s")).collect()}
    assert got[1] == pytest.approx(2 * 4 / 12) and got[2] == 0.0
    o = E.ngram_overlap(df, ["k"], F.split("h", " "), F.split("r", " "))
    b = {r["k"]: r for r in E.bleu(o, ["k"]).collect()}
    assert b[1]["bleu_1"] == pytest.approx(4 / 6) and b[2]["bleu_1"] == 0.0
    p = [4 / 6, 1 / 5, 1 / (2 * 4), 1 / (4 * 3)]
    assert b[1]["bleu_4"] == pytest.approx(float(np.exp(np.mean(np.log(p)))))


def test_bootstrap(spark):
    v = np.round(np.random.default_rng(2).beta(2, 3, 400), 4)
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("b", 0.5)] * 9 + [("c", 0.1)] * 2, "g string, v double")
    got = {r["g"]: r for r in E.bootstrap_ci(df, ["g"], "v").collect()}
    half = 1.96 * v.std() / 20
    assert got["a"]["ci_95_lower"] == pytest.approx(v.mean() - half, abs=0.01)
    assert got["a"]["ci_95_upper"] == pytest.approx(v.mean() + half, abs=0.01)
    assert got["b"]["ci_95_lower"] is None and got["c"]["statistically_valid"] is False


def test_triplets_against_brute_force(spark):
    rnd = random.Random(1)
    texts = [f"text number {i} that is clearly longer than fifty characters in all" for i in range(6)]
    rows = [(s, s * 1000 + i, rnd.choice(texts)) for s in range(5) for i in range(rnd.choice([1, 2, 12]))]
    got = {r["seq"]: r for r in E.triplets(spark.createDataFrame(rows, "source bigint, seq bigint, text string")).collect()}
    for s, q, t in rows:
        same = [(b, x) for a, b, x in rows if a == s and x != t]
        cross = [(b, x) for a, b, x in rows if a != s]
        cand = (same + cross)[:5]
        assert got[q]["n_candidates"] == len(cand)
        assert (got[q]["negative_seq"], got[q]["negative"]) == cand[q % len(cand)]


def test_triplets_move_a_chunk_once_to_its_candidates(spark):
    df = spark.createDataFrame([(1, 1, "a"), (None, 2, "b" * 60), (3, 3, "c" * 60), (3, 4, "d" * 60)], "source bigint, seq bigint, text string")
    out = E.triplets(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    got = {r["seq"]: (r["n_candidates"], r["negative_seq"]) for r in out.collect()}
    assert got == {2: (0, None), 3: (1, 4), 4: (1, 3)}


def test_containing_documents(spark):
    docs = [(1, "aaa bbb ccc ddd eee"), (2, "xxaaa bbb ccc dddxx"), (3, "bbb ccc"), (4, "aaa  bbb ccc ddd")]
    q = spark.createDataFrame([(1, "aaa bbb ccc ddd"), (2, "zzz bbb q")], "query_id int, text string")
    got = E.containing_documents(q, spark.createDataFrame(docs, "doc_id int, text string")).collect()
    assert sorted((r["query_id"], r["doc_id"]) for r in got) == [(1, 1), (1, 2)]
    docs = [(1, "xab cdy"), (2, "what ?! no"), (3, "é"), (4, ""), (5, None), (6, "ab"), (7, "one two three four")]
    q = spark.createDataFrame([(1, "ab cd"), (2, "?!"), (3, "é"), (4, "ab"), (5, ""), (6, "two three"), (7, "two three f")], "query_id int, text string")
    got = E.containing_documents(q, spark.createDataFrame(docs, "doc_id int, text string")).collect()
    assert sorted((r["query_id"], r["doc_id"]) for r in got) == [(1, 1), (2, 2), (3, 3), (4, 1), (4, 6), (6, 7), (7, 7)]


def test_ks(spark):
    rng = np.random.default_rng(0)
    same, far = rng.normal(size=200), rng.normal(3, 1, 200)
    rows = [("current", float(a), float(b)) for a, b in zip(same, far)] + [("reference", float(a), float(a)) for a in rng.normal(size=200)]
    got = {r["column"]: r for r in M.ks_drift(spark.createDataFrame(rows, "part string, a double, b double"), ["a", "b"]).collect()}
    assert not got["a"]["drift_detected"] and got["b"]["drift_detected"]
    few = M.ks_drift(spark.createDataFrame(rows[:3] + rows[-3:], "part string, a double, b double"), ["a"]).first()
    assert few["p_value"] is None and few["drift_detected"] is False


def test_spans(spark):
    page = "Intro text. The quick brown\n  fox jumps over the lazy dog and runs far away. End."
    needles = ["quick brown\n  fox", "The quick brown fox jumps over the lazy dog", "not in the page at all, no", " "]
    df = spark.createDataFrame([(page, n) for n in needles], "p string, c string")
    got = [r["s"] for r in df.select(V.find_text_span(F.col("p"), F.col("c")).alias("s")).collect()]
    assert (got[0]["start"], got[0]["stage"]) == (page.index("quick"), 1)
    assert (got[1]["start"], got[1]["stage"]) == (page.index("The quick"), 3)
    assert got[2]["start"] is None and got[3] is None
    assert page[got[1]["start"] : got[1]["end"]] == "The quick brown\n  fox jumps over the lazy dog"
    long = "The quick brown\n  fox jumps, and then " + "something else. " * 20
    one = spark.createDataFrame([(page, long)], "p string, c string")
    assert one.select(V.find_text_span(F.col("p"), F.col("c"))["stage"]).first()[0] == 0
    part = one.select(V.find_text_span(F.col("p"), F.col("c"), prefix=27).alias("s")).first()["s"]
    assert (part["stage"], page[part["start"] : part["end"]]) == (2, "The quick brown\n  fox jumps")


def test_opcodes(spark):
    df = spark.createDataFrame([("a\nb\nc\n", "a\nx\nc\nd\n"), ("a\nb", "a\nb")], "o string, n string")
    got = [r["d"] for r in df.select(V.line_opcodes("o", "n").alias("d")).collect()]
    assert (got[0]["n_added"], got[0]["n_removed"], got[0]["n_modified"]) == (1, 0, 1)
    assert got[1]["similarity"] == 1.0
    assert isinstance(pd.DataFrame(got), pd.DataFrame)


def test_far_readings_take_bit_vectors(spark):
    import random
    import time

    rng = random.Random(3)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        return row[-1]

    for _ in range(200):
        a, b = ("".join(rng.choices("abé\U0001F600", k=rng.randrange(90))) for _ in range(2))
        assert E.edit_distance(a, b) == plain(a, b)
    truth = "".join(rng.choices("thaiou", k=60_000))
    pred = truth.translate(str.maketrans("ai", "oj")).replace("th", "t")
    rows = [(truth, pred), ("x" * 300, ""), ("", "y"), ("ab" * 200, "ba" * 200)]
    t0 = time.time()
    got = [r["cer"] for r in E.with_cer(spark.createDataFrame(rows, "g string, p string").coalesce(1), "p", "g").collect()]
    assert time.time() - t0 < 25
    assert 0.3 < got[0] < 0.6 and got[1:] == [1.0, 1.0, 2 / 400]


def test_grams_of_a_pair_do_not_move(spark):
    """Only keys that come more than once are spelled out; their grams count together, as in the SQL."""
    from pyspark.sql import functions as F

    words = " ".join(f"w{i % 300}" for i in range(600))
    rows = [(i, words, words[: 40 * i] if i else None) for i in range(40)] + [(100, "a b a", "a a"), (100, "b c", "c a b"), (101, None, None)]
    df = spark.createDataFrame(rows, "k int, h string, r string")
    store = spark._jsc.sc().statusStore()

    def moved() -> dict:
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        every = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {every.apply(i).stageId(): every.apply(i).shuffleWriteRecords() for i in range(every.size())}

    before = moved()
    o = {(r.k, r.n): tuple(r)[2:] for r in E.ngram_overlap(df, ["k"], F.split("h", " "), F.split("r", " ")).collect()}
    assert sum(n for stage, n in moved().items() if stage not in before) < 500
    assert {n: o[100, n] for n in (1, 2, 3)} == {1: (4, 5, 5), 2: (1, 3, 3), 3: (0, 1, 1)} and (100, 4) not in o
    assert o[0, 1] == (0, 600, 0) and o[39, 4][1] == 597 and (101, 1) not in o
