import zlib
from collections import Counter, defaultdict

import numpy as np

from leafmill.llm import sharding
from leafmill.llm.queries import op7_sharding


def check(rows, texts, shards):
    slots, sizes, groups = defaultdict(list), Counter(), defaultdict(set)
    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(text) + 16, zlib.crc32(text))
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
        groups[text].add(r.shard)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return sizes, groups


def test_sizes_near_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for cells, off in ((512, 0.005), (16, 0.03)):  # the coarser the items, the less equal
        rows = sharding.shard(docs, 40, cells_per_shard=cells).collect()
        tokens = Counter()
        for r in rows:
            tokens[r.shard] += r.tokens
        assert max(tokens.values()) < 1.05 * sum(tokens.values()) / 40
        assert len(rows) == len(texts)
        sizes, groups = check(rows, texts, 40)
        mean = sum(sizes.values()) / 40
        assert max(sizes.values()) < (1 + off) * mean and min(sizes.values()) > (1 - off) * mean
        assert all(len(g) == 1 for g in groups.values())


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_sharding(spark, sf).collect()
    check(rows, texts, 40)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    assert sorted(rows) == sorted(op7_sharding(spark, sf).collect())


def test_a_group_larger_than_a_shard_is_split(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id < 1500, repeat('hot ', 20), concat('doc ', id, repeat(' x', 30))) as text")
    rows = sharding.shard(docs, 8, cells_per_shard=32).collect()
    sizes, groups = check(rows, {r.doc_id: r.text for r in docs.collect()}, 8)
    mean = sum(sizes.values()) / 8
    assert max(sizes.values()) < 1.05 * mean
    assert max(len(g) for g in groups.values()) > 1


def test_odd_rows_and_files(odd_docs, no_docs, tmp_path, spark):
    rows = sharding.shard(odd_docs, 3).collect()
    assert len(rows) == 9
    by = {r.doc_id: r for r in rows}
    assert by[3].shard == by[4].shard and by[3]["size"] == 16 and by[1].shard == by[2].shard
    assert sharding.shard(no_docs, 3).count() == 0
    docs = spark.range(50).selectExpr("id as doc_id", "cast(id as string) as text")
    plan = sharding.shard(docs, 4)
    sharding.write_shards(docs, plan, f"{tmp_path}/out", rows_per_file=5)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.doc_id, r.shard, r.slot) for r in back.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in plan.collect())


def test_placement_takes_the_highest_dot_product():
    where = sharding.place(np.array([[4.0, 1, 1], [3, 1, 1], [2, 1, 1], [1, 1, 1]]), 2)
    assert where[0] != where[1] and where[0] == where[3] and where[1] == where[2]
