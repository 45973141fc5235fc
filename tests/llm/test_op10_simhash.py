import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh64_intdigest

from leafmill.llm import simhash
from leafmill.llm.components import components
from leafmill.llm.queries import op10_simhash

M = (1 << 64) - 1


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def classes(items, linked):
    parent = {x: x for x in items}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(items):
        for b in items[:i]:
            if linked(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {x: root(x) for x in items}


def test_query_equals_brute_force(spark, sf):
    fp = {r.doc_id: brute(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = classes(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    rows = op10_simhash(spark, sf).collect()
    assert len(rows) == len(fp)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{fp[d]:016x}", want[d]) for d in fp}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB é\t\nÀ\x85 \x1c1", max_size=60))
def test_fingerprint(text):
    assert simhash.simhash(text.encode()) & M == brute(text)


@pytest.mark.parametrize("crowd", [4096, 5])
def test_links_of_close_fingerprints(spark, crowd):
    """Families of close fingerprints, also where every cell is crowded."""
    rng, fps = np.random.default_rng(7), set()
    for _ in range(12):
        centre = int(rng.integers(0, 1 << 63))
        for _ in range(25):
            flips = rng.choice(64, int(rng.integers(0, 5)), replace=False)
            fps.add(centre ^ sum(1 << int(b) for b in flips))
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), crowd=crowd)
    got = {r.id: r.component for r in components(links).collect()}
    want = classes(signed, lambda a, b: ((a ^ b) & M).bit_count() <= 3)
    assert {x: got.get(x, x) for x in signed} == want


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 9
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows}
    assert got[3] == got[4] == got[5] == (0, 3)
    assert got[1] == got[2] and got[2][1] == 1
    assert simhash.near_duplicates(no_docs).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(50)] + [(5, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 151
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
