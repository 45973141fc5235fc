from collections import Counter, defaultdict

from leafmill.llm import mixing
from leafmill.llm.queries import op3_mixing


def fill(sizes, weights, total):
    """Shares by weight; what is above twice a source's size is shared again until none is."""
    target, open_, left = {}, set(sizes), total
    while open_:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > 2 * sizes[s] + 1e-9}
        if not over:
            return target | {s: left * weights[s] / w for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_and_sums(spark, sf):
    rows = op3_mixing(spark, sf).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes, taken, biggest, target = Counter(), Counter(), Counter(), {}
    for r in rows:
        s = source[r.doc_id]
        sizes[s] += r["size"]
        taken[s] += r.taken
        biggest[s] = max(biggest[s], r["size"])
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    want = fill(sizes, weights, 1.5 * sum(sizes.values()))
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6
        assert abs(taken[s] - target[s]) <= biggest[s] / 2
    assert sorted(rows) == sorted(op3_mixing(spark, sf).repartition(3).collect())


def test_bins_do_not_change_the_choice(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    narrow = mixing.keyed(docs, None, "doc_id", "text", "source", "mix", []).cache()
    one, many = (
        {r.of: (r.target, r.epochs, r.last) for r in mixing.budgets(narrow, bin_rows=n).collect()} for n in (10**6, 7)
    )
    cut = {s: v for s, v in many.items() if v[2] is not None}  # no document of the last bin: the bin alone decides
    assert cut and all(one[s] == v for s, v in cut.items())
    taken = [
        sorted(
            (r.doc_id, r.copies)
            for r in narrow.join(p, narrow.source.eqNullSafe(p.of)).select("doc_id", mixing.copies().alias("copies")).collect()
        )
        for p in (mixing.budgets(narrow, bin_rows=n) for n in (10**6, 7))
    ]
    assert taken[0] == taken[1]


def test_heavier_documents_come_first(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i < 400 else "b") for i in range(500)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([(i, 4.0 if i % 2 else 1.0) for i in range(500)], "id long, weight double")
    got = mixing.mixed(docs, weights, share=0.4).where("taken > 0").collect()
    odd = sum(r.doc_id % 2 for r in got)
    assert odd > 0.6 * len(got)


def test_odd_rows(odd_docs, no_docs):
    rows = mixing.mixed(odd_docs).collect()
    assert len(rows) == 9
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r["size"], r.taken))
    assert by[3] == by[4] == by[5] == {(0, 0)} and len(by[2]) == 1
    assert mixing.mixed(no_docs).count() == 0
    texts = mixing.mixture(odd_docs)
    assert texts.columns == odd_docs.columns
    want = sum(r.taken for r in rows)
    assert sum(len((r.text or "").split()) for r in texts.collect()) == want
    assert mixing.mixture(no_docs).count() == 0
