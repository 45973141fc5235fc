import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 20_000 + "end"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    text = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = [
        (1, text, "en", "a", 5),
        (2, text, "en", "a", 5),
        (2, text, "en", "a", 5),
        (3, None, None, None, None),
        (4, "", "en", None, 0),
        (5, " \n\t ", None, "b", 4),
        (6, LONG, "de", "b", len(LONG)),
        (None, "no id at all", "en", "a", 3),
        (7, "Zwei\n\nWörter </s> <|x|> 😀", "de", "c", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    extra = {c: "n_chars" for c in ("size", "row", "key", "fp", "start", "kept", "digest", "words", "n", "shard", "item", "slot", "h1", "h2", "line_no", "at", "_row", "_k1", "_of", "_weight", "of", "whole")}
    return df.selectExpr("*", *[f"{v} as {k}" for k, v in extra.items()])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
