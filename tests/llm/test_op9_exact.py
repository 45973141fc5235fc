import hashlib
import re
import uuid

from leafmill.llm import exact
from leafmill.llm.shared import checkpointed


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_groups_and_odd_rows(spark, odd_docs, no_docs):
    every = checkpointed(exact.digests(odd_docs))
    index = exact.DigestIndex(spark, f"t_{uuid.uuid4().hex}", 4)
    rows = exact.deduplicated([every], index).collect()
    texts = {(r.doc_id, r.text) for r in odd_docs.collect()}
    digest = {d: hashlib.sha256(norm(t).encode()).digest() for d, t in texts}
    assert len(rows) == 9 and all(bytes(r.digest) == digest[r.doc_id] for r in rows)
    kept = [r.doc_id for r in rows if r.kept]
    assert sorted(kept, key=str) == sorted([1, 3, 5, 6, 7, None], key=str)
    assert {r.doc_id: (r.keep_id, r.group_size) for r in rows}[2] == (1, 3)
    assert {r.doc_id: (r.keep_id, r.group_size) for r in rows}[4] == (3, 2)
    index.drop()
    empty = exact.DigestIndex(spark, f"t_{uuid.uuid4().hex}", 4)
    assert exact.deduplicated([checkpointed(exact.digests(no_docs))], empty).count() == 0
    empty.drop()


def batch(spark, rows):
    return checkpointed(exact.digests(spark.createDataFrame(rows, "doc_id long, text string")))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_is_read_in_a_second_session(spark):
    name = f"t_{uuid.uuid4().hex}"
    exact.DigestIndex(spark, name, 3).append(batch(spark, [(5, "a b"), (6, "c")]))
    other = spark.newSession()
    again = exact.DigestIndex(other, name)
    assert again.buckets == 3
    again.append(batch(other, [(1, "a  b"), (2, "d"), (3, "d")]))
    again.append(batch(other, [(1, "a  b"), (2, "d"), (3, "d")]))
    assert sorted(r.keep_id for r in exact.DigestIndex(spark, name).rows().collect()) == [2, 5, 6]
    again.drop()
    assert not exact.DigestIndex(spark, name).runs()


def test_runs_are_neither_shuffled_nor_sorted(spark):
    index = exact.DigestIndex(spark, f"t_{uuid.uuid4().hex}", 3)
    for k in range(3):
        index.append(batch(spark, [(10 * k + i, f"text {10 * k + i}") for i in range(10)]))
    with exact._sorted_scans(spark):
        plan = plan_of(index.unseen(checkpointed(exact._first(batch(spark, [(99, "text 3"), (98, "new")])))))
        one, two = (name for _, _, name in index.runs())
        merging = plan_of(index.merged(one, two))
    assert plan.count("SortMergeJoin") == 2 and plan.count("Bucketed: true") == 2
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1  # the batch's own
    assert merging.count("SortMergeJoin") == 1 and "Exchange" not in merging and "Sort [" not in merging
    assert spark.conf.get(exact._TRUST_ORDER) == "false"
    index.drop()


def test_many_batches_leave_few_runs(spark):
    index = exact.DigestIndex(spark, f"t_{uuid.uuid4().hex}", 2)
    want = {}
    for k in range(7):
        texts = [(100 * k + i, f"word {(7 * k + 3 * i) % 23}") for i in range(6)]
        index.append(batch(spark, texts))
        for d, t in texts:
            want.setdefault(t, d)
        runs = index.runs()
        assert len(index._tables()) == len(runs) == (k + 1).bit_count()
        assert [r[0] for r in runs] == [0, *[r[1] + 1 for r in runs[:-1]]] and runs[-1][1] == k
    got = {bytes(r.digest): r.keep_id for r in index.rows().collect()}
    assert got == {hashlib.sha256(t.encode()).digest(): d for t, d in want.items()}
    index.drop()


def test_a_merge_that_died_before_dropping_is_not_read_twice(spark):
    index = exact.DigestIndex(spark, f"t_{uuid.uuid4().hex}", 2)
    for k in range(3):
        index.append(batch(spark, [(k, f"t{k}"), (10 + k, None)]))
    before = sorted(r.keep_id for r in index.rows().collect())
    index._write(index.merged(*[name for _, _, name in index.runs()]), 0, 2)  # the old runs are still there
    assert len(index._tables()) == 3 and len(index.runs()) == 1
    assert sorted(r.keep_id for r in index.rows().collect()) == before == [0, 1, 2, 10]
    index.append(batch(spark, [(7, "t1"), (8, "new")]))
    assert len(index._tables()) == 2 and sorted(r.keep_id for r in index.rows().collect()) == [0, 1, 2, 8, 10]
    index.drop()
