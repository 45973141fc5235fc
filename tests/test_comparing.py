import re

import numpy as np
import pytest

from leafmill.operators import comparing as C


def jobs(seed=4):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for job, n in ((1, 2), (2, 9), (3, 1), (4, 51), (5, 50)):
        for d in range(n):
            text = ". ".join(" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(rng.integers(1, 6)))
            rows.append((job, job * 100 + d, text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "job int, doc int, text string").repartition(3)


def walk(sentences, rounds=8, damping=0.85):
    """Dense matrices: sentence to term to sentence."""
    terms = sorted({w for s in sentences for w in re.findall(r"\b\w{2,}\b", s.lower())})
    m = np.array([[t in set(re.findall(r"\b\w{2,}\b", s.lower())) for t in terms] for s in sentences], float).reshape(len(sentences), len(terms))
    down = m / np.maximum(m.sum(axis=1, keepdims=True), 1)
    up = (m / np.maximum(m.sum(axis=0, keepdims=True), 1)).T
    r = np.full(len(sentences), 1 / len(sentences))
    for _ in range(rounds):
        r = (1 - damping) / len(sentences) + damping * (r @ down @ up)
    return r


def test_summary_against_matrices(spark):
    rows = jobs()
    got = C.summary(frame(spark, rows), "job", "doc", "text", k=4).collect()
    assert {r.job for r in got} == {1, 2, 5}
    for job in (1, 2, 5):
        own = []
        for _, d, t in sorted(r for r in rows if r[0] == job):
            parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+", t)]
            own += [(d, i, s) for i, s in enumerate(x for x in parts if x)]
        r = walk([s for _, _, s in own])
        best = sorted((-round(x, 9), d, i, s) for x, (d, i, s) in zip(r, own))[:4]
        mine = sorted((-x.score, x.doc, x.at, x.sentence) for x in got if x.job == job)
        assert [(pytest.approx(a, abs=2e-9), *b) for a, *b in best] == mine


def test_similarity_and_difference(spark):
    rows = [(1, 1, "apple apple pear"), (1, 2, "apple pear pear"), (1, 3, "plum fig"), (2, 4, "alone here"), (3, 5, None), (3, 6, "kiwi kiwi")]
    sim = {(r.doc_a, r.doc_b): (r.n_shared, r.score) for r in C.similarity(frame(spark, rows), "job", "doc", "text").collect()}
    assert sim == {(1, 2): (2, pytest.approx(80.0))}
    diff = {r.doc: (r.n_own, r.share, r.terms) for r in C.difference(frame(spark, rows), "job", "doc", "text").collect()}
    assert diff == {1: (0, 0.0, ""), 2: (0, 0.0, ""), 3: (2, 1.0, "fig plum"), 6: (1, 1.0, "kiwi")}
    assert {r.job for r in C.similarity(frame(spark, jobs()), "job", "doc", "text").collect()} <= {1, 2, 5}


def plain(rows):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("compare", [C.similarity, C.difference, C.summary])
def test_short_and_long_jobs_agree(spark, compare):
    """The rows do not tell whether a job was compared in one task or by joins."""
    rows = [*jobs(7), (6, 601, "ünï ünï. Ünï two"), (6, 602, None), (7, 701, ""), (7, 702, "")]
    df = frame(spark, rows)
    some = sorted(sum(len(t or "") for j, _, t in rows if j == job) for job in (1, 2, 5))[1]
    every = [plain(compare(df, "job", "doc", "text", job_chars=n).collect()) for n in (C.JOB_CHARS, some, -1)]
    assert every[0] and every[0] == every[1] == every[2]


def test_short_jobs_need_no_rounds(spark):
    """One shuffle of the texts, whatever the number of steps."""
    plan = C.summary(frame(spark, jobs()), "job", "doc", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 0 and plan.count("hashpartitioning(job") == 1
