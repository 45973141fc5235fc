import time

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import chunking as C
from leafmill.operators import filters as L
from leafmill.plans.text import dedupe_questions


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,want",
    [("5.2 crores", 52_000_000.0), ("18 lakhs", 1_800_000.0), ("1,00,000", 100_000.0), ("none", None), ("2 cr", 20_000_000.0)],
)
def test_indian_number(spark, text, want):
    got = one(spark, X.indian_number(F.col("t")), t=text)
    assert got == pytest.approx(want) if want is not None else got is None


@pytest.mark.parametrize(
    "text,want",
    [("on 05/08/2023", "2023-08-05"), ("1-2-2020", "2020-02-01"), ("3.4.1999", "1999-04-03"), ("32/01/2020", None), ("13/13/2020", None)],
)
def test_indian_date(spark, text, want):
    assert one(spark, X.indian_date(F.col("t")), t=text) == want


def test_ids(spark):
    assert one(spark, X.valid_pan(F.col("t")), t="abcde1234f")
    assert not one(spark, X.valid_pan(F.col("t")), t="ABCD1234F")
    assert one(spark, X.valid_aadhaar(F.col("t")), t="2345 6789-0123")


def test_wer_tokens(spark):
    got = one(spark, X.tokenize_wer(F.col("t")), t="Hello, world! Don't stop.")
    assert got == ["Hello", ",", "world", "!", "Don't", "stop", "."]


def test_normalise_and_escape(spark):
    assert one(spark, X.normalise_text(F.col("t")), t="  Hello​  World  ") == "hello world"
    assert one(spark, X.escape_prompt(F.col("t")), t='a<b>&"\'\\') == "a\\<b\\>\\&\\\"\\'\\\\"
    assert one(spark, X.term_normalise(F.col("t")), t="Kattam selevu x") == "table expense x"


def test_scrub_order(spark):
    t = "mail a.b@x.org call 415-555-1234 card 4111 1111 1111 1111 Patient: John Smith"
    got = one(spark, X.scrub_pii(F.col("t")), t=t)
    for tag in ("[EMAIL REDACTED]", "[PHONE REDACTED]", "[CARD REDACTED]", "[PATIENT NAME REDACTED]"):
        assert tag in got
    assert one(spark, X.has_pii(F.col("t")), t=t) and not one(spark, X.has_pii(F.col("t")), t="plain words")


def test_scrub_word_edge_is_unicode(spark):
    assert one(spark, X.scrub_pii(F.col("t")), t="épourenr est") == "épourenr est"


def test_split_recursive_covers_text():
    text = "one two. three four\n\nfive six seven. " * 40
    parts = C.split_recursive(text, 60, 10)
    assert all(0 < len(p) <= 60 for p in parts)
    assert set(" ".join(parts).split()) == set(text.split())
    assert C.split_recursive("x" * 150, 60, 0) == ["x" * 60, "x" * 60, "x" * 30]


def test_parent_child_sizes(spark):
    df = spark.createDataFrame([(1, "s", "alpha beta. " * 100 + "\nshort\n" + "gamma " * 30)], "doc_id int, source string, text string")
    ch = C.parent_child_chunks(C.text_blocks(df)).collect()
    assert {r["block_index"] for r in ch} == {0, 1, 2} and max(len(r["text"]) for r in ch) <= 400
    with pytest.raises(ValueError):
        C.parent_child_chunks(C.text_blocks(df), 400, 400)


def test_pack_words(spark):
    got = one(spark, C.pack_words(F.split("t", ";"), 3, "|"), t="a b;c;d e f g;h")
    assert got == ["a b|c", "d e f g", "h"]


def test_subquestions(spark):
    qs = ["What is the total amount due?", "what is the total amount now?", "short", "Who signed the contract then?"]
    df = spark.createDataFrame([(qs,)], ["q"]).select(dedupe_questions(F.col("q"), 10, 20, 4).alias("x"), dedupe_questions(F.col("q")).alias("y"))
    assert df.first()["x"] == ["What is the total amount due?", "Who signed the contract then?"]
    assert df.first()["y"] == qs


def test_filter_grammar(spark):
    df = spark.createDataFrame([(1, "a", ["x"], 5), (2, None, ["y", "z"], None)], "id int, language string, tags array<string>, page_number int")

    def ids(spec):
        return [r["id"] for r in df.where(L.metadata_filter(df, spec, L.ALLOWED_KEYS)).orderBy("id").collect()]

    assert ids({"language": None}) == [2]
    assert ids({"language": {"$ne": "q"}}) == [1]
    assert ids({"tags": {"$in": ["z", "q"]}}) == [2]
    assert ids({"page_number": {"$gte": 5}}) == [1] and ids({"page_number": "5"}) == []
    for bad in ({"nope": 1}, {"language": {"$regex": "a"}}, {"language": {"$in": "a"}}):
        with pytest.raises(ValueError):
            L.validate_filter(bad)


def test_markdown_and_pipe_rows(spark):
    rows = one(spark, X.pipe_rows(F.col("t")), t="a | b | c\nnoise\n1 | 2\n")
    assert rows == [["a", "b", "c"], ["1", "2", ""]]
    assert one(spark, X.pipe_rows(F.col("t")), t="only | one") is None


def test_segments_are_packed_as_one_by_one(spark):
    import random

    rnd = random.Random(6)
    rows = [(k, i * 3 + 1, " ".join(["w"] * rnd.choice([0, 1, 2, 3, 5, 9, 14]))) for k in range(6) for i in range(rnd.choice([1, 2, 40, 90]))]
    rows += [(9, i, "one two three") for i in range(700)] + [(10, 1, None)]
    got = C.pack_segments(spark.createDataFrame(rows, "k int, at int, text string"), "k", "at", "text", 10, bin_rows=16).collect()
    want = []
    for k in {r[0] for r in rows}:
        chunks, n = [], 0
        for _, _, text in sorted(r for r in rows if r[0] == k):
            words = len((text or "").split())
            if chunks and n + words <= 10:
                chunks[-1].append(text or "")
                n += words
            else:
                chunks.append([text or ""])
                n = words
        want += [(k, i, "\n".join(c)) for i, c in enumerate(chunks)]
    assert sorted((r.k, r.chunk_index, r.chunk) for r in got) == sorted(want)


def test_short_texts_have_no_language_of_their_own(spark, tmp_path):
    from leafmill.plans.text import detect_language
    from leafmill.sources.tables import Tables

    rows = [(1, "Re.", "en", "s", 3), (5, "Reed", "en", "s", 4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.language for r in detect_language(Tables(spark, str(tmp_path))).collect()}
    assert got == {1: "en", 5: "ta"}  # nine and ten characters


def test_registered_scrubbing_reads_edges_like_its_sql(spark, tmp_path):
    import duckdb

    from leafmill.plans.text import _scrub_sql, scrub_pii
    from leafmill.sources.tables import Tables

    texts = ["possible potential", "ñ123-45-6789é", "Name: Jon Doe ", " a\x0b", "éPO 12345 PO 67890", "ſigned po", None, ""]
    rows = [(i, x, "en", "s", 0) for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in scrub_pii(Tables(spark, str(tmp_path))).select("doc_id", "clean").collect())
    sql = f"select doc_id, {_scrub_sql('text')} from read_parquet('{tmp_path}/documents.parquet/*.parquet') order by 1"
    assert got == duckdb.connect().execute(sql).fetchall()
    both = docs.where("doc_id = 0").select(X.scrub_pii(F.col("text"))).first()[0]
    assert both == "[PO REDACTED] [PO REDACTED]"  # the operator by itself leaves neither


def test_many_lines_take_time_in_proportion(spark):
    """Each line is looked at once: 40,000 lines in one text, which took the square of that."""
    text = "\n".join("| a |" if i // 3 % 2 else f"line {i}" for i in range(40_000))
    began = time.monotonic()
    got = spark.createDataFrame([(text,), ("",), ("a",), ("|a\n|b\nc\n\n-",), (None,)], "text string").select(X.table_segments(F.col("text")).alias("s")).collect()
    assert time.monotonic() - began < 30
    assert len(got[0].s) == 13_334 and "\n".join(x.text for x in got[0].s) == text and got[4].s is None
    assert [[tuple(x) for x in r.s] for r in got[1:4]] == [[(False, 0, "")], [(False, 0, "a")], [(True, 0, "|a\n|b"), (False, 2, "c\n"), (True, 4, "-")]]


def test_script_looks_at_other_letters_once(spark):
    """One pass takes out what belongs to no script; the counts read what is left."""
    df = spark.createDataFrame([("abc தமிழ் हि xyz " * 3,), ("हिन्दी தமிழ் abc",), ("latin only",), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(X.detect_script(F.col("text"))).collect()] == ["tamil", "hindi", None, None, None]
    long = spark.createDataFrame([("latin words without end " * 400_000,)], "text string").select(X.detect_script(F.col("text")).alias("s"))
    began = time.monotonic()
    assert long.first().s is None and time.monotonic() - began < 5
