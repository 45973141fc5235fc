import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from leafmill.llm import packing
from leafmill.llm.queries import op1_packing, tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def check(pieces, texts, tokenizer, window):
    """Every document's ids lie in its pieces exactly once, sequences are gapless and at most a window long."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in pieces:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    assert set(docs) == set(texts)
    for d, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(docs[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[at : at + r.length]
            at += r.length
        assert at == len(ids)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return seqs


def test_pieces_of_a_table(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces = packing.pack(docs, tokenizer_path()).collect()
    seqs = check(pieces, texts, tokenizer, 4096)
    total = sum(r.length for r in pieces)
    assert len(seqs) <= -(-total // 4096) * 1.02 + 1
    got = {(r.doc_id, r.start): r.ids_crc32 for r in op1_packing(spark, sf).collect()}
    assert got == {(r.doc_id, r.start): zlib.crc32(r.ids) for r in pieces}


@pytest.mark.parametrize("window", [1, 7, 64, 4096])
def test_windows(spark, tokenizer, window):
    texts = {i: "naïve café's <|endoftext|>x 12 don't\t　ЖÅ " * (i % 9) for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(packing.pack(docs, tokenizer_path(), window=window, block_tokens=200).collect(), texts, tokenizer, window)


def test_odd_rows(odd_docs, no_docs):
    rows = packing.pack(odd_docs, tokenizer_path()).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r.length)
    assert by[3] == by[4] == by[5] == [1]
    assert by[2][0] == by[2][1] == by[1][0] and len(by[2]) == 2 and len(by[None]) == 1
    assert sorted(by[6])[-1] == 4096 and sum(by[6]) == 20_002
    assert packing.pack(no_docs, tokenizer_path()).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 51, 400)
    where, offset, n = packing.best_fit_decreasing(lengths, 50)
    room, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [r for r in room if r >= lengths[i]]
        best = min(fits) if fits else 50
        room.remove(best) if fits else None
        if best > lengths[i]:
            room.append(best - lengths[i])
        want[int(i)] = best - lengths[i]
    after = {int(i): 50 - int(offset[i]) - int(lengths[i]) for i in range(400)}
    assert after == want
    assert n == len(set(where))


def test_cache_generations_and_odd_words(tokenizer):
    encode = packing.WordIds(tokenizer_path(), max_words=8)
    texts = ["It's a, B. c., d.. <|endoftext|>. <|ENDOFTEXT|> É. é, ΣΑΣ ΑΣ. İ. ǰ J̌. x", "a, b. É. 12. don't'S. 's 'S"] * 3
    for t in texts + [f"w{i}. W{i} w{i}" for i in range(40)]:
        assert np.frombuffer(encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
