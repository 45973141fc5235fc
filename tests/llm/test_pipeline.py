"""The pipeline stage by stage against the brute-force versions of its operators."""

import numpy as np
from test_op1_packing import check
from test_op6_lines import brute as brute_lines
from test_op10_simhash import brute as brute_hash
from test_op10_simhash import classes
from tokenizers import Tokenizer

import corpus_pipeline as P
from leafmill.llm import mixing
from leafmill.llm.queries import op5_quality, quality_weights, tokenizer_path
from leafmill.llm.shared import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(stored(stage(spark, out[-1], sf)))
    text = [{r.doc_id: r.text for r in d.collect()} for d in out[:4]]
    assert all(d.columns == COLUMNS for d in out[:5])

    kept = {r.doc_id for r in op5_quality(spark, sf).where("kept").collect()}
    assert set(text[1]) == kept and all(text[1][d] == text[0][d] for d in kept)

    groups, _ = brute_lines(text[1].items())
    want = {}
    for d, t in text[1].items():
        lines = [x for i, x in enumerate(t.split("\n")) if groups.get((d, i), ((d, i), 1))[0] == (d, i)]
        want[d] = "\n".join(lines)
    assert text[2] == {d: t for d, t in want.items() if t.strip(" \t\n\x0b\x0c\r")}
    assert all(r.n_chars == len(r.text) for r in out[2].collect())

    fp = {d: brute_hash(t) for d, t in text[2].items()}
    group = classes(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    assert text[3] == {d: t for d, t in text[2].items() if group[d] == d}

    labels = quality_weights(spark.read.parquet(f"{sf}/labels.parquet"))
    taken = {r.doc_id: (r["size"], r.taken) for r in mixing.mixed(out[3], labels).collect()}
    times = {}
    for r in out[4].collect():
        assert r.text == text[3][r.doc_id]
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == {d: t // s for d, (s, t) in taken.items() if t}

    rows = out[5].collect()
    once = {d: t for d, t in text[3].items() if times.get(d) == 1}
    check([r for r in rows if r.doc_id in once], once, Tokenizer.from_file(tokenizer_path()), 4096) if len(once) == len(times) else None
    starts = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length
        starts.setdefault(r.doc_id, []).append(r.start)
    assert {d: s.count(0) for d, s in starts.items()} == times


def test_odd_rows_and_no_rows(spark, odd_docs, no_docs, sf):
    """Nulls, repeats and clashing columns go through every stage but the first, which would reject them all."""
    for docs in (odd_docs, no_docs):
        now = docs
        for _, stage in P.STAGES[1:4]:
            now = stored(stage(spark, now, sf))
            assert now.columns == docs.columns
        assert P.pack_windows(spark, now, sf).count() >= (now.count() > 0)
        assert P.quality_rules(spark, docs, sf).count() == 0
    ids = [r.doc_id for r in stored(P.near_dedup(spark, odd_docs, sf)).collect()]
    assert sorted(ids, key=str) == sorted([1, 3, 6, 7, None], key=str)
