"""Different documents without an id, or under one id, are decided on and cut one by one."""

import corpus_pipeline as P
from leafmill.llm.shared import stored

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NUMBERS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(seed, n=80):
    """``n`` words without a repeated window of three."""
    return " ".join(f"{NUMBERS[(i * seed + i // 12) % 12]}{'abcdefghij'[i % 10]}{'abcdefgh'[i // 10]}" for i in range(n))


def texts(df):
    return sorted((r.doc_id or 0, r.text) for r in stored(df).collect())


def test_quality_decides_by_row(spark, sf):
    for doc_id in (None, 7):
        good, bad = prose(5), "no no no no"
        docs = spark.createDataFrame([(doc_id, t, "en", "a", len(t)) for t in (good, bad)], DOCS)
        assert texts(P.quality_rules(spark, docs, sf)) == [(doc_id or 0, good)]


def test_lines_are_cut_by_row(spark, sf):
    for doc_id in (None, 7):
        first = "one line of alpha words\nanother line of beta words\nthe common line stands here"
        second = "something of a third kind\nmore of the fourth sort\nthe common line stands here"
        third = "quite other words again\nyet different words too\nits own third line stays"
        docs = spark.createDataFrame([(doc_id, t, "en", "a", len(t)) for t in (first, second, third)], DOCS)
        got = [t for _, t in texts(P.line_dedup(spark, docs, sf))]
        assert third in got and sum("the common line stands here" in t for t in got) == 1
        assert sum(len(t.split("\n")) for t in got) == 8


def test_near_dedup_keeps_unlike_documents(spark, sf):
    for doc_id in (None, 7):
        unlike = [prose(5), prose(7)[::-1], prose(11).upper()[::2]]
        docs = spark.createDataFrame([(doc_id, t, "en", "a", len(t)) for t in (*unlike, unlike[0])], DOCS)
        assert texts(P.near_dedup(spark, docs, sf)) == sorted((doc_id or 0, t) for t in unlike)
    both = spark.createDataFrame([(i, prose(5), "en", "a", 1) for i in (None, 3)], DOCS)
    assert texts(P.near_dedup(spark, both, sf)) == [(3, prose(5))]
