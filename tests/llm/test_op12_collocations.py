import re
from collections import Counter

import numpy as np
import pytest

from leafmill.llm import collocations as C

FOLD = {c: c + 32 for c in range(65, 91)}


def grams(docs, longest):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return n, f


def brute(docs, longest=3, least=10, cover=50, top=2000):
    n, f = grams(docs, longest)
    cands = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cands.items():
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, l, r = min(cuts, key=lambda c: c[:2])
        inside = any(
            g == lang and len(q) > len(p) and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q)))
            for (g, q), b in cands.items()
        )
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    rows = []
    for lang, found in out.items():
        for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, i, p.decode(), -a, l, r, n[lang], -s))
    return sorted(rows)


def make(seed=3, n=250):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "é", "日本", "(x)", "a\x00b", "\x01", "it's", "\x1c"]
    p = 1 / np.arange(1, len(words) + 1) ** 1.1
    p /= p.sum()
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", ";x ", "\r\n", " ! "]
    phrases = ["New York City", "hot dog", "w1 w2 w3", "foo  bar"]

    def text():
        out = []
        for w in rng.choice(words, rng.integers(0, 120), p=p):
            out.append(phrases[rng.integers(4)] if rng.random() < 0.05 else w.upper() if rng.random() < 0.1 else w)
            out.append(ends[rng.integers(len(ends))])
        return "".join(out)

    docs = [(["en", "de", None][i % 3], text()) for i in range(n)]
    return docs + [docs[0]] * 40 + [("en", None), (None, ""), ("fr", " .,; "), ("xx", "lone")]


def rows(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("args", [{}, {"longest": 2}, {"least": 2, "cover": 30, "top": 50}])
def test_equals_brute_force(spark, args):
    docs = make()
    df = spark.createDataFrame(docs, "lang string, text string").repartition(6)
    got = rows(C.collocations(df.selectExpr("*", "1 as length", "lang as phrase", "2 as f", "3 as part", "4 as w1"), **args))
    assert got == brute(docs, **args) and len(got) > 30


def test_spills_bursts_and_merges(monkeypatch):
    """Tiny limits: many bursts, runs, renumberings, blocks and flushes, with borders inside hot prefixes."""
    docs = make(5, 120)
    monkeypatch.setattr(C, "STEP", 64)
    monkeypatch.setattr(C, "BLOCK", 5)
    state, runs = C.Grams(3, held=200, burst=20, words=60), []
    for lang, text in docs:
        runs += state.feed("und" if lang is None else lang, (text or "").encode())
    assert max(len(node.child) for node in state.tries.values()) > 0
    runs += state.finish()
    assert len(runs) > 40
    for _, words, ranks, _ in runs:
        assert words == sorted(words) and (np.diff(C._joined(ranks)) > 0).all()
    spelled = sorted({(lang, tuple(words[r] for r in g)) for lang, words, ranks, _ in runs for g in ranks.T[::7].tolist()})
    borders = [*spelled[::40], ("en", (b"w1", b"w2", b"")), ("en", (b"w1zz", b"", b"")), ("zz", (b"a", b"", b""))]
    borders = sorted(set(borders), key=lambda x: (x[0].encode(), x[1]))
    blocks = sorted(b for run in runs for b in C.blocks_of(run, borders, 3))
    total, n = Counter(), Counter()
    for part in sorted({b[0] for b in blocks}):
        merge = C.Merge(3, 2, held=30)
        told = [t for b in blocks if b[0] == part for t in merge.feed(b[1], b[2:-1], b[-1])] + list(merge.finish())
        for lang, length, phrase, f in told:
            (total if length else n)[(lang, tuple(phrase.decode().split(" "))) if length else lang] += f
    want_n, want = grams(docs, 3)
    assert {k: v for k, v in n.items() if v} == {k: v for k, v in want_n.items() if v}
    assert {k: v for k, v in total.items() if v >= 2} == {k: v for k, v in want.items() if v >= 2}


def test_words_beyond_a_key(monkeypatch):
    monkeypatch.setattr(C, "WORD", 10)
    words = [f"{i:02d}".encode() for i in range(30)]
    block = C._packed([b"", *words], np.array([[1, 2, 30], [2, 3, 0], [3, 0, 0]]), np.array([4, 5, 6]))
    merge = C.Merge(3, 1)
    told = list(merge.feed("en", (words[0], words[1], words[2]), block)) + list(merge.feed("en", (words[0], words[1], words[2]), block))
    told += list(merge.finish())
    assert ("en", 3, b"00 01 02", 8) in told and ("en", 2, b"01 02", 10) in told and ("en", 1, b"29", 12) in told


def test_odd_rows(spark, odd_docs, no_docs):
    got = rows(C.collocations(odd_docs, least=1))
    assert got == brute([(r.lang, r.text) for r in odd_docs.collect()], least=1)
    assert rows(C.collocations(no_docs)) == []
    with pytest.raises(ValueError):
        C.phrase_counts(no_docs, 4)
