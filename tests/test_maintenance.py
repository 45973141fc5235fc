import os

import pytest
from pyspark.sql import functions as F

from leafmill.operators.maintenance import VectorStore
from leafmill.sources.folders import scan_folder
from leafmill.sources.scratch import scratch_path


def embed(scale, seen=None, broken=()):
    def run(df):
        rows = df.collect()
        if seen is not None:
            seen.append(len(rows))
        if len(seen or ()) in broken:
            raise RuntimeError("embedder is down")
        some = df.where("text is not null and key % 10 <> 3")
        return some.select("key", F.when(F.col("key") % 10 != 4, F.array(F.lit(scale) * F.col("key"))).alias("embedding"))

    return run


def test_new_version_resumes_and_is_swapped_in(spark):
    chunks = spark.createDataFrame([(i, f"t{i}" if i else None) for i in range(100)], "key long, text string").repartition(3)
    store = VectorStore(spark, scratch_path(spark, "vectors"))
    assert store.current() is None and store.vectors().count() == 0
    assert tuple(store.re_embed(chunks, "one", embed(1.0), 4).first()) == ("one", 79, 21)
    assert store.current() == "one"
    seen = []
    with pytest.raises(RuntimeError):
        store.re_embed(chunks, "two", embed(2.0, seen, broken=(3,)), 4)
    assert store.current() == "one" and store.done_parts("two") == {0, 1}
    assert {r.key: r.embedding[0] for r in store.vectors().collect()}[5] == 5.0
    seen.clear()
    assert tuple(store.re_embed(chunks, "two", embed(2.0, seen), 4).first()) == ("two", 79, 21)
    assert len(seen) == 2 and store.current() == "two"  # only the parts that were missing
    assert {r.key: r.embedding[0] for r in store.vectors().collect()} == {i: 2.0 * i for i in range(1, 100) if i % 10 not in (3, 4)}
    assert sorted(r.key for r in store.failed("two").collect()) == [i for i in range(100) if i == 0 or i % 10 in (3, 4)]
    seen.clear()
    assert store.re_embed(chunks, "two", embed(9.0, seen), 4).count() == 1 and not seen


def test_folder_scan(spark, tmp_path):
    png, pdf, zip_ = bytes.fromhex("89504E470D0A1A0A00"), b"%PDF-1.7\n", b"PK\x03\x04\x14"
    files = {
        "a.pdf": pdf, "b.txt": pdf, "c.docx": zip_, "d.xlsx": zip_, "e.zip": zip_, "f.png": png, "g.mp4": b"none", "h.txt": b"hello",
        "i.bin": b"\x00\x01", "j.txt": b"", "k l.pdf": pdf, "m.pdf": b"%PDF", "sub/n.jpg": bytes.fromhex("FFD8FFE000"), "sub/o": b"x" * 100_000,
    }
    (tmp_path / "sub").mkdir()
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.name: (r.format, r.confidence, r.length) for r in scan_folder(spark, str(tmp_path)).collect()}
    assert {n: v[2] for n, v in got.items()} == {os.path.basename(n): len(d) for n, d in files.items() if d}
    want = {
        "a.pdf": ("pdf", 1.0), "b.txt": ("pdf", 1.0), "c.docx": ("docx", 1.0), "d.xlsx": ("xlsx", 1.0), "e.zip": ("docx", 1.0), "f.png": ("png", 1.0),
        "g.mp4": ("mp4", 0.9), "h.txt": ("txt", 0.8), "i.bin": ("unknown", 0.0), "k l.pdf": ("unknown", 0.0),
        "m.pdf": ("pdf", 0.8), "o": ("unknown", 0.0),
    }
    assert {n: got[n][:2] for n in want} == want and got["n.jpg"][1] == 1.0
    assert scan_folder(spark, str(tmp_path), "*.pdf", deep=False).count() == 3
    plan = scan_folder(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_vector_of_zeros_is_a_failure(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "b")], "key long, text string")
    store = VectorStore(spark, scratch_path(spark, "vectors"))
    zero = lambda df: df.select("key", F.array(F.lit(0.0), F.when(F.col("key") == 1, 0.0).otherwise(1.0)).alias("embedding"))
    assert tuple(store.re_embed(chunks, "one", zero, 2).first()) == ("one", 1, 1)
    assert [r.key for r in store.failed("one").collect()] == [1]
