"""URL filters: rules first, then naive Bayes over segmented host words and path tokens.

Host names such as ``freemoviesonline`` are split into words by a Viterbi search under a unigram model, which is
counted over the visible text of all pages. Each distinct name is segmented once: its substrings are looked up in the
model by a join. The
classifier learns from weak labels of all pages: hosts with a listed word and pages of symbol junk are bad. Its
tokens are hashed into a fixed number of buckets, so the model has a proven size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.shared import checkpointed, join_checked

#: Fixed rules: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Fixed words of the weak labels: names that unwanted sites give themselves.
BAD_WORDS = (
    "adult", "ads", "betting", "casino", "escort", "gambling", "malware", "phishing", "pills", "porn", "sex", "spam",
    "torrent", "viagra", "warez", "xxx",
)

_LONGEST_WORD = 20
#: Labels of host names end at 63 characters; longer runs of letters are cut into pieces of that length.
_LONGEST_NAME = 63
#: Hosts of so many bytes in all, with their words, are broadcast: below 100 MB even if every letter is a word.
_SMALL_HOSTS = 4 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (``host`` and its subdomains, path prefix) and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def visible(html: Column) -> Column:
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(text, r"&#?\w+;", " ")


def unigrams(texts: DataFrame, text: Column) -> DataFrame:
    """``(word, n)`` over all texts."""
    word = F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)))
    return texts.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def segment(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable split of ``name``; unknown words cost ten times more for each letter."""
    log_total = math.log(max(total, 1))
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - _LONGEST_WORD), end):
            word = name[start:end]
            n = counts.get(word)
            cost = log_total - math.log(n) if n else log_total + len(word) * math.log(10)
            options.append((best[start][0] + cost, start))
        best.append(min(options))
    words, end = [], len(name)
    while end:
        words.append(name[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


def segmented(names: DataFrame, model: DataFrame) -> DataFrame:
    """``names(name)``, distinct, of at most 63 characters -> ``(name, words)``."""
    total = int(model.agg(F.sum("n")).first()[0] or 1)
    inner = F.expr(
        "array_distinct(flatten(transform(sequence(1, length(name)), i -> "
        f"transform(sequence(1, least({_LONGEST_WORD}, length(name) - i + 1)), k -> substring(name, i, k)))))"
    )
    pieces = names.select("name", F.explode(inner).alias("word"))
    usable = model.where(F.length("word") <= _LONGEST_WORD)  # no longer one is ever looked up: at most 100 bytes a row
    known = join_checked(pieces, usable, "word", max_rows=500_000).groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    @F.pandas_udf("array<string>")
    def split(names: pd.Series, known: pd.Series) -> pd.Series:
        counts = ({r["word"]: r["n"] for r in found} if found is not None else {} for found in known)
        return pd.Series([segment(n, c, total) for n, c in zip(names, counts)])

    return names.join(known, "name", "left").select("name", split("name", "known").alias("words"))


def host_words(hosts: DataFrame, model: DataFrame) -> DataFrame:
    """``hosts(host)``, distinct -> ``(host, words)``: its names between dots, hyphens and digits, segmented in order.

    A name of more than 63 letters, which no real host has, is segmented in pieces of 63, so the work grows with the
    length of a host, not with its square. A host without letters has no words.
    """
    runs = F.filter(F.split(F.lower("host"), r"[^\p{L}]+"), lambda n: n != "")
    names = F.flatten(F.transform(runs, lambda n: F.regexp_extract_all(n, F.lit(f".{{1,{_LONGEST_NAME}}}"), F.lit(0))))
    keys = [F.xxhash64(F.lit(k), "host").alias(f"k{k}") for k in (1, 2)]  # hosts of any length are grouped by 128 bits
    named = checkpointed(hosts.select(*keys, F.posexplode(names).alias("at", "name")))
    words = checkpointed(segmented(named.select("name").distinct(), model))
    placed = join_checked(named, words, "name", max_rows=100_000)  # at most 63 characters a row, twice
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "words"))), lambda p: p["words"]))
    by_host = placed.groupBy("k1", "k2").agg(whole.alias("words"))
    none = F.array().cast("array<string>")
    return hosts.select("host", *keys).join(by_host, ["k1", "k2"], "left").select("host", F.coalesce("words", none).alias("words"))


def tokens(words: Column, path: Column) -> Column:
    """Host words and path tokens, told apart by a letter; digits are one token."""
    parts = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda p: p != "")
    plain = F.transform(parts, lambda p: F.concat(F.lit("p:"), F.regexp_replace(p, r"^\p{N}+$", "0")))
    return F.concat(F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w)), plain)


def fit(rows: DataFrame, buckets: int = 1 << 16, smooth: float = 0.1) -> tuple[float, np.ndarray]:
    """Multinomial naive Bayes of ``rows(features: array<int>, bad)``: prior and per-bucket log odds of bad.

    At most ``buckets`` counts (two longs each) reach the driver. Buckets that no row has tell nothing (0).
    """
    n = {r["bad"]: r["n"] for r in rows.groupBy("bad").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros((2, buckets))
    each = rows.select(F.explode("features").alias("f"), "bad")
    both = each.groupBy("f").agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad"))
    for f, good, bad in both.collect():
        counts[:, f] = good, bad
    seen = counts.sum(axis=0) > 0
    share = np.log((counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * max(1, seen.sum())))
    prior = math.log((n.get(True, 0) + smooth) / (n.get(False, 0) + smooth))
    return prior, np.where(seen, share[1] - share[0], 0.0)


def judge(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    rules=RULES,
    bad_words: tuple[str, ...] = BAD_WORDS,
    junk_percent: int = 5,
    buckets: int = 1 << 16,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, words, log_odds``; one row per input row.

    A rule decides where one fits; elsewhere a page is blocked if its log odds of being bad are above 0. Null urls and
    urls without ``://`` have empty host and path and no tokens, so the prior decides; null pages are no junk. Repeated
    rows are judged alike; an empty table gives no rows.
    """
    host, path = host_and_path(F.col(url_col))
    text = visible(F.col(html_col))
    junk = F.regexp_count(text, F.lit(r"[#*$%|]{3}")) * 100 > junk_percent * F.regexp_count(text, F.lit(r"\p{L}+"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), junk.alias("junk"))
    rows = checkpointed(rows)
    model = checkpointed(unigrams(pages, text))
    hosts = checkpointed(host_words(rows.select("host").distinct(), model))
    small = (hosts.agg(F.sum(F.octet_length("host") + 16)).first()[0] or 0) <= _SMALL_HOSTS
    known = rows.join(F.broadcast(hosts) if small else hosts, "host", "left")
    bad = F.col("junk") | F.arrays_overlap("words", F.array(*[F.lit(w) for w in bad_words]))
    features = F.transform(tokens(F.col("words"), F.col("path")), lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    known = known.select("page_id", "host", "path", "words", F.coalesce(bad, F.lit(False)).alias("bad"),
                         features.alias("features"), name.alias("rule"), verdict.alias("ruled"))
    prior, odds = fit(known, buckets)

    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        return pd.Series([prior + float(odds[f].sum()) for f in features], dtype="float64")

    scored = known.withColumn("log_odds", score("features"))
    method = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "words", "log_odds")
