"""Tables whose own columns are named like the operators' inner ones, and many rows without an id."""

import numpy as np

import corpus_pipeline as P
from leafmill.llm import lines, mixing, sharding


def test_lines(odd_docs):
    got = lines.every_line_groups(odd_docs).collect()
    plain = lines.every_line_groups(odd_docs.select("doc_id", "text")).collect()
    assert sorted(map(str, got)) == sorted(map(str, plain)) and got


def test_stages_keep_all_columns(spark, odd_docs, sf):
    docs = odd_docs
    for _, stage in P.STAGES[:4]:
        docs = stage(spark, docs, sf)
        assert docs.columns == odd_docs.columns
        docs.collect()


def test_shards_with_columns_of_the_plan(spark, tmp_path):
    docs = spark.range(30).selectExpr("id as doc_id", "cast(id as string) as text", "-id as shard", "7 as slot", "8 as slot_", "9 as _of")
    plan = sharding.shard(docs, 4)
    sharding.write_shards(docs, plan, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    where = {r.doc_id: (r.shard, r.slot) for r in plan.collect()}
    assert {r.doc_id: (r.shard, r.slot) for r in back} == where
    assert all((r.shard_, r.slot__, r.slot_, r._of_) == (-r.doc_id, 7, 8, 9) for r in back)


def test_mixture_of_rows_without_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(None if i % 3 == 0 else i, f"s{i % 4}", f"t{i} " * int(rng.integers(1, 40))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mixed(docs).collect()
    assert len(got) == 3000 and all(r.taken <= 2 * r["size"] for r in got)
    totals = docs.selectExpr("source", "size(split(trim(text), ' ')) as n").groupBy("source").sum("n").collect()
    taken = {r["sum(n)"]: 0 for r in totals}
    target = {r.source_size: r.target for r in got}
    for r in got:
        taken[r.source_size] += r.taken
    assert all(abs(taken[z] - target[z]) <= 40 for z in taken)
