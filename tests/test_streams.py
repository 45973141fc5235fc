"""Streams give the rows of their batch twins; late rows are dropped; replays add nothing."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafmill.operators.ranking import cooldown_gate, sliding_rate_limit
from leafmill.sources import sinks
from leafmill.operators.textindex import TextIndex
from leafmill.streaming import streams as S


@pytest.fixture()
def folder(tmp_path):
    for d in ("in", "out", "cp"):
        (tmp_path / d).mkdir()
    return tmp_path


def drain(stream, folder, mode="append", name="o"):
    out, cp = str(folder / "out" / name), str(folder / "cp" / name)
    if mode == "update":
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda b, i: b.write.mode("append").parquet(out))
    else:
        q = stream.writeStream.outputMode(mode).format("parquet").option("path", out)
    q = q.option("checkpointLocation", cp).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return out


def events(spark, sf, folder, pieces=3):
    ev = spark.read.parquet(f"{sf}/events.parquet").toPandas().sort_values("ts")
    step = -(-len(ev) // pieces)
    for i in range(pieces):
        part = spark.createDataFrame(ev.iloc[i * step : (i + 1) * step], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
        part.coalesce(1).write.mode("append").parquet(str(folder / "in"))
    return S.event_stream(spark, str(folder / "in"), 1), ev


def test_rate_limit_stream(spark, sf, folder):
    stream, ev = events(spark, sf, folder, 1)
    shape = lambda df: df.select((F.col("user_id") % 5).alias("key"), F.lit("ingest").alias("grp"), F.col("event_id").alias("request_id"), "ts")
    window = 3600 * 12
    out = spark.read.parquet(drain(S.rate_limit_stream(shape(stream), window), folder)).toPandas()
    batch = shape(spark.createDataFrame(ev).withColumn("ts", F.col("ts").cast("timestamp")))
    want = sliding_rate_limit(batch, ["key"], "grp", window, "request_id").toPandas()
    assert dict(zip(out["request_id"], out["allowed"])) == dict(zip(want["request_id"], want["allowed"]))
    assert not out["allowed"].all()


@pytest.mark.parametrize("late", [False, True])
def test_rate_limit_stream_in_batches(spark, folder, late):
    """State across micro-batches; a late request within the watermark gets the batch answer too."""
    window, t = 3600, pd.Timestamp("2024-01-01")
    n = 30
    ids = list(range(n))
    order = [*ids[:12], *ids[13:], 12] if late else ids
    rows = [(i, (t + pd.Timedelta(minutes=2 * i)).to_pydatetime(), "k", "ingest") for i in ids]
    schema = "request_id int, ts timestamp, key string, grp string"
    for b in range(3):
        part = [rows[i] for i in order[b * 10 : (b + 1) * 10]]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    out = spark.read.parquet(drain(S.rate_limit_stream(src, window), folder)).toPandas()
    want = sliding_rate_limit(spark.createDataFrame(rows, schema), ["key"], "grp", window, "request_id").toPandas()
    got, want = (dict(zip(d["request_id"], d["allowed"])) for d in (out, want))
    assert got[12] == want[12] and len(got) == n
    if not late:
        assert got == want


def test_windows_match_batch(spark, sf, folder):
    stream, ev = events(spark, sf, folder)
    out = spark.read.parquet(drain(S.usage_counters(stream), folder)).toPandas()
    want = S.usage_counters(spark.createDataFrame(ev).withColumn("ts", F.col("ts").cast("timestamp"))).toPandas()
    both = out.merge(want, on=["day", "user_id", "n_actions", "n_queries", "n_uploads"], how="left", indicator=True)
    # append mode gives closed days only
    assert (both["_merge"] == "both").all() and 0 < len(out) <= len(want)
    assert out["day"].nunique() >= want["day"].nunique() - 2


def test_late_rows_are_dropped(spark, folder):
    def put(rows, n):
        cols = ["event_id", "ts", "user_id", "event_type", "value", "props"]
        spark.createDataFrame(pd.DataFrame(rows, columns=cols), "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(str(folder / "in" / f"p{n}"))

    t = pd.Timestamp("2024-01-01")
    day = pd.Timedelta(days=1)
    put([(1, t, 1, "view", 1.0, "{}"), (2, t + 5 * day, 1, "view", 1.0, "{}")], 0)
    src = spark.readStream.schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").parquet(str(folder / "in" / "*")).withColumn("ts", F.col("ts").cast("timestamp"))
    drain(S.usage_counters(src), folder)
    put([(3, t + day / 2, 1, "view", 1.0, "{}"), (4, t + 9 * day, 1, "view", 1.0, "{}")], 1)
    got = spark.read.parquet(drain(S.usage_counters(src), folder)).toPandas()
    assert got["n_actions"].sum() == 2 and t + 5 * day in set(got["day"])


def test_cooldown_stream(spark, sf, folder):
    stream, ev = events(spark, sf, folder)
    alerts = lambda df: df.where("value > 60").select((F.col("user_id") % 3).alias("tenant"), "ts")
    out = spark.read.parquet(drain(S.cooldown_stream(alerts(stream)), folder)).toPandas()
    twin = cooldown_gate(alerts(spark.createDataFrame(ev)), "tenant", "ts").toPandas()
    want = {(r.tenant, int(r.ts.value // 1000)) for r in twin.itertuples()}
    assert {(r.tenant, r.at_us) for r in out.itertuples()} == want


def test_task_progress_stream(spark, sf, folder):
    stream, ev = events(spark, sf, folder)
    tasks = stream.select((F.col("user_id") % 4).alias("task"), "ts", F.col("event_type").alias("state"))
    out = spark.read.parquet(drain(S.task_progress_stream(tasks, 40 * 86400), folder, "update")).toPandas()
    last = out.sort_values("n_events").groupby("task").tail(1).set_index("task")
    ev["task"] = ev["user_id"] % 4
    want = ev.sort_values("ts").groupby("task").agg(state=("event_type", "last"), n=("event_id", "count"))
    assert (last["state"].sort_index() == want["state"]).all() and (last["n_events"].sort_index() == want["n"]).all()


def test_task_history_stream(spark, sf, folder):
    """All events with their places, over micro-batches and expired histories, as in the batch twin."""
    stream, ev = events(spark, sf, folder)
    tasks = lambda df: df.select((F.col("user_id") % 4).alias("task"), "ts", F.col("event_id").alias("tie"), F.when(F.col("event_type") == "purchase", "complete").otherwise(F.col("event_type")).alias("state"))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = spark.read.parquet(drain(S.task_history_stream(tasks(stream), 7200), folder)).toPandas()
    finally:
        spark.conf.unset(key)
    rows = lambda df: sorted(zip(df["task"], df["seq"], df["at_us"], df["state"], df["terminal"]))
    want = S.task_history(tasks(spark.createDataFrame(ev)), 7200).toPandas()
    assert rows(out) == rows(want) and (out["seq"] == 1).sum() > 8 and out["terminal"].any()


def test_incremental_ingest_into_an_index(spark, sf, folder):
    """Chunks, postings and vectors of arriving documents; replays and repeated files add nothing."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.limit(60).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    read = lambda: spark.readStream.schema(docs.schema).parquet(str(folder / "in"))
    index = TextIndex(spark, str(folder / "out" / "index"), "string")
    S.incremental_ingest(read(), index, str(folder / "cp" / "a")).awaitTermination(240)
    first = S.stored_chunks(index).count()
    assert first > 0 and index.segments() == ["batch_0"]
    S.incremental_ingest(read(), index, str(folder / "cp" / "b"), "again").awaitTermination(240)
    assert S.stored_chunks(index).count() == first and index.totals()[0] == index.documents().count()
    assert not S.ingest_batch(docs, index, "batch_0")  # a replayed batch
    assert S.stored_chunks(index).count() == first
    docs.coalesce(1).write.mode("append").parquet(str(folder / "in"))
    S.incremental_ingest(read(), index, str(folder / "cp" / "b"), "again").awaitTermination(240)
    want = S.ingest_chunks(docs).select("chunk_id", "text").distinct()
    assert sorted(tuple(r) for r in S.stored_chunks(index).select("chunk_id", "text").collect()) == sorted(tuple(r) for r in want.collect())
    assert index.vectors().count() == index.vectors().select("key").distinct().count()
    # the index answers as one that is built at once
    whole = TextIndex(spark, str(folder / "out" / "whole"), "string")
    whole.add("all", want, "chunk_id")
    q = spark.createDataFrame([(1, docs.first().text[:200])], "query_id int, text string")
    hits = lambda i: [(r.doc_id, r.score) for r in i.search(q, 10).orderBy("rank").collect()]
    assert hits(index) == hits(whole) and len(hits(index)) == 10
    assert index.compact("one") and hits(index) == hits(whole) and S.stored_chunks(index).count() == want.count()


def test_ingest_reads_its_own_prefixes(spark, folder):
    index = TextIndex(spark, str(folder / "out" / "small"), "string")
    make = lambda ids: spark.createDataFrame([(i, "s", f"line number {i}") for i in ids], "doc_id long, source string, text string")
    for n in range(3):
        assert S.ingest_batch(make(range(n * 5, n * 5 + 8)), index, f"b{n}", most_segments=2)
    assert S.stored_chunks(index).count() == 18 and len(index.segments()) <= 2
    own = [r.prefix for r in S.ingest_chunks(make([0])).select(F.substring("chunk_id", 1, 1).alias("prefix")).collect()]
    plan = S.stored_chunks(index, own)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and own[0] in plan.split("PartitionFilters")[1]


def test_csv_and_dead_letters(spark, folder):
    df = spark.createDataFrame([(1, None, "x,y"), (2, "b", "z")], "id int, a string, c string")
    path = str(folder / "out" / "csv")
    sinks.csv_report(df, path, ["c", "id", "a"])
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["c", "id", "a"] and {tuple(r) for r in back.collect()} == {("x,y", "1", None), ("z", "2", "b")}
    good, bad = sinks.dead_letter(df, {"no_a": F.col("a").isNull(), "comma": F.col("c").contains(",")})
    assert good.count() == 1 and bad.first()["reasons"] == ["no_a", "comma"]
    rows = spark.createDataFrame([("en", "v1", 1, 5)], "domain string, version string, id int, n int")
    sinks.write_dataset(rows, str(folder / "out" / "ds"))
    assert spark.read.parquet(str(folder / "out" / "ds")).count() == 1
