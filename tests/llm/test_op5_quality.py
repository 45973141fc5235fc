import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(lines),
    )


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab  \n\t\x0bé#|😀\x85\x1c", max_size=60), min_size=1, max_size=60))
def test_measures(spark, texts):
    texts = [*texts, None, "", "a b c a b c", "x " * 5000, "a b c d e a b c d e\nz\nz\n z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    got = {r.i: tuple(r[c] for c in cols) for r in quality.measures(df, keep={"i": F.col("doc_id")}).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_sketches_merge_and_bound_the_error(spark):
    values = [*range(200), 1000, 12345, 10**6, 2**40]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = df.select("v", quality._bin(F.col("v")).alias("b")).select("v", "b", quality._edge(F.col("b")).alias("e"))
    last = -1
    for r in got.orderBy("v").collect():
        assert r.b >= last and r.v <= r.e <= r.v * (1 + 1 / 32) + 1
        last = r.b
        if r.v < 64:
            assert r.e == r.v


def test_odd_rows(odd_docs, no_docs):
    rows = quality.judged(odd_docs).collect()
    assert len(rows) == 9
    by = {r.doc_id: r for r in rows}
    assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and by[3].base_failed and not by[3].kept
    assert by[6].n_words == 20_001 and by[6].base_failed
    assert quality.judged(no_docs).count() == 0


def test_the_odd_one_of_a_group_goes(spark):
    plain = "these are plain words of one group " * 1
    rows = []
    for i in range(300):
        words = [f"{plain.split()[(i + j) % 7]}{(i * 7 + j) % 90}" for j in range(80)]
        text = " ".join(words)
        if i % 50 == 7:
            text = " ".join(w + "%%%" for w in words)
        if i % 50 == 9:
            text = " ".join(w * 6 for w in words)
        rows.append((i, text, None if i % 2 else "en", "s"))
    got = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    kept = defaultdict(set)
    for r in got:
        kept[r.kept].add(r.doc_id % 50)
    assert kept[False] == {7, 9} and not {7, 9} & kept[True]
