import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import urls
from leafmill.llm.queries import op8_urls


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    low = "".join(c.lower() if c.isascii() else c for c in host)
    return low, re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


def test_query(spark, sf):
    url = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op8_urls(spark, sf).collect()
    assert len(rows) == len(url)
    for r in rows:
        host, path = parse(url[r.page_id])
        name, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name)
        assert r.verdict == verdict or name is None and r.verdict in ("allow", "block")


def test_method_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = urls.judge(docs).collect()
    html = {r.page_id: r.html for r in docs.select("page_id", urls.visible(F.col("html")).alias("html")).collect()}
    counts = Counter(w for t in html.values() for w in re.findall(r"[^\W\d_]+", t.lower()))
    for host, words in {(r.host, tuple(r.words)) for r in rows}:
        names = [n for n in re.split(r"[^a-z]+", host) if n]
        assert list(words) == [w for n in names for w in urls.segment(n, counts, sum(counts.values()))]

    def features(r):
        parts = [p for p in re.split(r"[^a-z0-9]+", r.path.lower()) if p]
        return [f"h:{w}" for w in r.words] + ["p:" + ("0" if p.isdigit() else p) for p in parts]

    seen = {True: Counter(), False: Counter()}
    n = Counter()
    for r in rows:
        text = html[r.page_id]
        junk = 100 * len(re.findall(r"[#*$%|]{3}", text)) > 5 * len(re.findall(r"[^\W\d_]+", text))
        bad = junk or bool(set(r.words) & set(urls.BAD_WORDS))
        n[bad] += 1
        seen[bad].update(features(r))
    size = {c: sum(seen[c].values()) + 0.1 * len(seen[True] | seen[False]) for c in seen}

    def odds(r):
        prior = math.log((n[True] + 0.1) / (n[False] + 0.1))
        return prior + sum(
            math.log((seen[True][f] + 0.1) / size[True]) - math.log((seen[False][f] + 0.1) / size[False]) for f in features(r)
        )

    for r in rows:
        assert r.log_odds == pytest.approx(odds(r), abs=1e-6)
        if r.rule is None:
            assert r.verdict == ("block" if r.log_odds > 0 else "allow")
    method = [r for r in rows if r.rule is None]
    flagged = {r.host for r in method if r.verdict == "block"}
    assert flagged and all(set(re.split(r"[^a-z]+", h)) & set(urls.BAD_WORDS) for h in flagged)


def test_segmentation_is_the_best_split():
    counts = {"spam": 50, "farm": 40, "spa": 30, "free": 90, "movies": 20, "online": 60, "on": 500, "line": 70, "m": 3}
    total = sum(counts.values())

    def cost(words):
        return sum(math.log(total) - math.log(counts[w]) if w in counts else math.log(total) + len(w) * math.log(10) for w in words)

    for name in ("spamfarm", "freemoviesonline", "qzspam", "on", ""):
        got = urls.segment(name, counts, total)
        assert "".join(got) == name
        splits = []
        for k in range(len(name)):
            for cuts in itertools.combinations(range(1, len(name)), k):
                at = [0, *cuts, len(name)]
                splits.append([name[a:b] for a, b in zip(at, at[1:])])
        assert not splits or cost(got) == pytest.approx(min(map(cost, splits)))
    assert urls.segment("freemoviesonline", counts, total) == ["free", "movies", "online"]
    long = urls.segment("online" * 500, counts, total)
    assert len(long) == 500


def test_odd_rows(spark):
    rows = [
        (1, None, None), (2, "no scheme", "<p>a b</p>"), (3, "x://", ""), (4, "http://EXAMPLE.com?x=://y", None),
        (4, "http://EXAMPLE.com?x=://y", None), (5, "HTTPS://a.Net/es/1#z", "<b>word</b>"), (6, "http://xn.com.evil/" + "a/" * 20_000, "x"),
        (7, "ftp://www.example.com/en/x", "y"), (8, "http://notexample.com/en/", "y"), (9, "http://com", "z"), (None, "a://b/\nc", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "url as host", "1 as n", "url as words")
    got = urls.judge(pages).collect()
    assert len(got) == len(rows)
    url = {r[0]: r[1] for r in rows}
    for r in got:
        host, path = parse(url[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule(host, path)[0])
    assert {r.page_id: r.rule for r in got}[8] == "com/" and {r.page_id: r.rule for r in got}[9] is None
    assert urls.judge(pages.limit(0)).count() == 0
    assert np.isfinite([r.log_odds for r in got]).all()


def test_long_hosts_in_pieces(spark):
    rng = random.Random(5)
    letters = "".join(rng.choice("abcdefgh") for _ in range(1_000_000))
    hosts = ["spamfarm.example.com", "a" * 63 + "." + "b" * 64, letters, "1.2.3.4", "", "Ünï-ürl" * 30, "online" * 30]
    texts = spark.createDataFrame([("spam farm example com online on line ünï ab ab cde",)], "text string")
    model = urls.unigrams(texts, F.col("text"))
    counts = {r.word: r.n for r in model.collect()}
    began = time.monotonic()
    got = {r.host: r.words for r in urls.host_words(spark.createDataFrame([(h,) for h in hosts], "host string"), model).collect()}
    assert time.monotonic() - began < 120
    for h in hosts:
        names = [n for n in re.split(r"[^a-zäöüï]+", h.lower()) if n]
        pieces = [n[i : i + 63] for n in names for i in range(0, len(n), 63)]
        assert got[h] == [w for p in pieces for w in urls.segment(p, counts, sum(counts.values()))], h[:30]
    assert got["spamfarm.example.com"] == ["spam", "farm", "example", "com"] and got["1.2.3.4"] == got[""] == []
