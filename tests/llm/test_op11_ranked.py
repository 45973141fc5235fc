import math
import re
from collections import Counter

import numpy as np

from leafmill.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [w.translate(FOLD) for w in TERM.findall(text or "")]


def brute(items, docs, k):
    cut = [(d, Counter(terms(t))) for d, t in docs]
    cut = [(d, c, sum(c.values())) for d, c in cut if c]
    n_docs, total = len(cut), sum(n for *_, n in cut)
    df = Counter(t for _, c, _ in cut for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in asked.items():
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in ts}
        scored = []
        for d, c, n in cut:
            m = 50 + 50 * n * n_docs // total
            s = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def make(spark, seed=1, n=900):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(150)] + ["É", "é", "naïve", "日本語", "a1", "0"]
    weights = 1 / np.arange(1, len(words) + 1)
    weights /= weights.sum()
    join = [" ", "-", "\t", "_", "@", "  "]

    def text():
        ws = rng.choice(words, rng.integers(1, 40), p=weights)
        return "".join(w.upper() + join[rng.integers(len(join))] if rng.random() < 0.2 else w + " " for w in ws)

    docs = [(int(i), text()) for i in range(n)]
    docs += [(int(i), docs[3][1]) for i in range(n, n + 120)] + [(7, docs[3][1]), (None, docs[3][1]), (5000, None), (5001, ""), (5002, "--")]
    items = [(i, text()) for i in range(70)] + [(70, None), (71, ""), (72, docs[3][1]), (72, "w0 w1"), (None, "w2 É"), (73, "unseen")]
    return items, docs


def test_equals_brute_force(spark):
    items, docs = make(spark)
    q = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = rows(ranked.search(q, d, 50))
    assert got == brute(items, docs, 50)
    assert rows(ranked.search(q, d, 3, tile_bytes=700)) == brute(items, docs, 3)


def test_small_tiles_and_bounded_sums(spark, monkeypatch):
    weights = np.array([40_000] * 50, np.int64)
    monkeypatch.setattr(ranked, "EXACT", 40_000 * ranked.IMPACT_BOUND * 7)
    tile = ranked.Tile([np.arange(50), np.arange(3, 9)], weights)
    assert max(e - s for s, e in tile.parts) <= 7 and [s for s, _ in tile.parts] == [0] + [e for _, e in tile.parts[:-1]]
    assert tile.parts[-1][1] == 50
    row, term = np.repeat(np.arange(2), 50), np.tile(np.arange(50), 2)
    impact = np.random.default_rng(0).integers(1, ranked.IMPACT_BOUND, 100)
    want = [[int((impact[row == r][s] * 40_000).sum()) for s in (slice(0, 50), slice(3, 9))] for r in (0, 1)]
    assert tile.scores(2, row, term, impact).tolist() == want


def test_odd_rows(spark, odd_docs, no_docs):
    q = odd_docs.selectExpr("doc_id as item_id", "text", "n", "key")
    got = rows(ranked.search(q, odd_docs, 5))
    pairs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got == brute(pairs, pairs, 5)
    assert rows(ranked.search(q, no_docs)) == [] == rows(ranked.search(q.limit(0), odd_docs))


def test_long_texts_are_cut_in_slices():
    text = ("ab cd " * 400_000 + "x" * 3_000_000 + " tail").encode()
    c = ranked.term_counts(text)
    assert c == Counter({b"ab": 400_000, b"cd": 400_000, b"x" * 3_000_000: 1, b"tail": 1})
