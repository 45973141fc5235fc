"""Structured Streaming operators. Windowed ones are plain DataFrame functions, so a batch gives the same rows."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafmill.functions import text as X
from leafmill.functions import vectors as V
from leafmill.operators import chunking as C
from leafmill.operators.ranking import RATE_LIMITS
from leafmill.operators.running import previous, running
from leafmill.operators.textindex import TextIndex
from leafmill.sources.scratch import written
from leafmill.sources.tables import SCHEMAS


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """Event log files as they arrive, with a declared schema."""
    raw = spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def metrics_windows(events: DataFrame, keep: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Sliding statistics with retention; rows later than ``keep`` are dropped by the watermark."""
    return (
        events.withWatermark("ts", keep)
        .groupBy(F.window("ts", keep, slide).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("max_value"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total", "max_value")
    )


def usage_counters(events: DataFrame, key: str = "user_id", every: str = "1 day") -> DataFrame:
    return (
        events.withWatermark("ts", every)
        .groupBy(F.window("ts", every).alias("w"), key)
        .agg(
            F.count("*").alias("n_actions"),
            F.count_if(F.col("event_type") == "view").alias("n_queries"),
            F.count_if(F.col("event_type") == "click").alias("n_uploads"),
        )
        .select(F.col("w.start").alias("day"), key, "n_actions", "n_queries", "n_uploads")
    )


def session_windows(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each key: events less than ``gap`` apart belong together; ends are the last event plus the gap."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), key)
        .agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
        .select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events", "total")
    )


def alert_rules(requests: DataFrame, window: str, slide: str) -> DataFrame:
    """Rules over requests(ts, is_error, seconds, is_quota, is_pending) per sliding window.

    A percentile rule "p99 above T" is the share of requests above T being over 1 %, so every rule is a count.
    """
    n = F.count("*")

    def share(c: Column) -> Column:
        return F.count_if(c) / n

    return (
        requests.withWatermark("ts", window)
        .groupBy(F.window("ts", window, slide).alias("w"))
        .agg(
            n.alias("n"),
            (share(F.col("is_error")) > 0.05).alias("high_error_rate"),
            (share(F.col("seconds") > 5) > 0.01).alias("p99_above_5s"),
            (share(F.col("seconds") > 10) > 0.05).alias("p95_above_10s"),
            (F.count_if("is_quota") > 0).alias("quota_error"),
            (F.count_if("is_pending") > 100).alias("backlog"),
        )
        .select(F.col("w.start").alias("window_start"), "n", "high_error_rate", "p99_above_5s", "p95_above_10s", "quota_error", "backlog")
    )


def latest_state(events: DataFrame, key: str, order: Column, value: Column) -> DataFrame:
    """Latest state per key (update mode when streaming)."""
    return events.groupBy(key).agg(F.max_by(value, order).alias("state"), F.max("ts").alias("last_ts"), F.count("*").alias("n_events"))


def rate_limit_stream(requests: DataFrame, window_s: int) -> DataFrame:
    """Allow or deny requests(key, grp, request_id, ts) per key and endpoint group.

    A request passes when fewer than ``limit`` requests precede it in the window. The state holds the times of two
    windows, so that a request as late as the watermark lets in is judged by what came before it in time; decisions
    already given out are not revised. State ends one minute after the window.
    """
    window_us = window_s * 1_000_000

    def decide(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        limit = RATE_LIMITS.get(k[1], RATE_LIMITS["default"])
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at_us", "request_id"])
        # requests of one instant all see each other; a late one sees only what lies before it
        times = sorted(times + rows["at_us"].tolist())
        for at, group in rows.groupby("at_us", sort=True):
            n = bisect_right(times, at) - bisect_right(times, at - window_us)
            yield pd.DataFrame({"key": k[0], "grp": k[1], "request_id": group["request_id"], "allowed": n <= limit})
        # what a request as late as the watermark lets in may still need
        times = times[bisect_right(times, times[-1] - 2 * window_us) :]
        state.update((times,))
        state.setTimeoutTimestamp(max(int(times[-1] // 1000 + (window_s + 60) * 1000), state.getCurrentWatermarkMs() + 1))

    types = dict(requests.dtypes)
    out = f"key {types['key']}, grp string, request_id {types['request_id']}, allowed boolean"
    return (
        requests.withWatermark("ts", f"{window_s} seconds")
        .withColumn("at_us", F.unix_micros("ts"))
        .groupBy("key", "grp")
        .applyInPandasWithState(decide, out, "times array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    )


def cooldown_stream(alerts: DataFrame, hours: float = 24.0) -> DataFrame:
    """At most one action per tenant per ``hours``; the state is the last action's time."""
    gap_us = int(hours * 3_600_000_000)

    def fold(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        fired = []
        for at in sorted(pd.concat(list(batches))["at_us"]):
            if last is None or at - last >= gap_us:
                fired.append(at)
                last = at
        if last is not None:
            state.update((int(last),))
            state.setTimeoutTimestamp(max(int((last + gap_us) // 1000), state.getCurrentWatermarkMs() + 1))
        if fired:
            yield pd.DataFrame({"tenant": k[0], "at_us": fired})

    tenant = dict(alerts.dtypes)["tenant"]
    return (
        alerts.withWatermark("ts", "1 hour")
        .withColumn("at_us", F.unix_micros("ts"))
        .groupBy("tenant")
        .applyInPandasWithState(fold, f"tenant {tenant}, at_us bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)
    )


def task_progress_stream(events: DataFrame, ttl_s: int = 600) -> DataFrame:
    """Latest state per task(task, ts, state); a task silent for ``ttl_s`` seconds of event time is forgotten."""

    def fold(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, value, n = state.get if state.exists else (-1, None, 0)
        for pdf in batches:
            n += len(pdf)
            top = pdf.loc[pdf["at_us"].idxmax()]
            if top["at_us"] >= at:
                at, value = int(top["at_us"]), top["state"]
        state.update((at, value, n))
        state.setTimeoutTimestamp(max(at // 1000 + ttl_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"task": [k[0]], "at_us": [at], "state": [value], "n_events": [n], "terminal": [value in ("complete", "failed")]})

    task = dict(events.dtypes)["task"]
    return (
        events.withWatermark("ts", f"{ttl_s} seconds")
        .withColumn("at_us", F.unix_micros("ts"))
        .groupBy("task")
        .applyInPandasWithState(
            fold, f"task {task}, at_us bigint, state string, n_events bigint, terminal boolean",
            "at bigint, state string, n bigint", "update", GroupStateTimeout.EventTimeTimeout,
        )
    )


#: States that end a task.
TERMINAL = ("complete", "failed")
HISTORY = "task {task}, seq int, at_us bigint, state string, terminal boolean"


class TaskHistory(StatefulProcessor):
    """Numbers a task's events in the order of their time; the list of them is forgotten ``ttl_s`` after the last one."""

    def __init__(self, ttl_s: int):
        self.ttl_us = ttl_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "at_us bigint, state string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["at_us", "tie"], kind="stable")
        known = [tuple(e) for e in self.events.get()] if self.events.exists() else []
        last = max((e[0] for e in known), default=None)
        out, added = [], []
        for at, state in zip(new["at_us"].tolist(), new["state"].tolist()):
            if last is not None and at > last + self.ttl_us:
                known, added = [], []
                self.events.clear()
            last = at if last is None or not known + added else max(last, at)
            added.append((at, state))
            out.append((key[0], len(known) + len(added), at, state, state in TERMINAL))
        if added:
            self.events.appendList(added)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.ttl_us) // 1000 + 1)
        yield pd.DataFrame(out, columns=["task", "seq", "at_us", "state", "terminal"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.events.clear()
        return iter(())

    def close(self) -> None:
        pass


def task_history_stream(events: DataFrame, ttl_s: int = 600) -> DataFrame:
    """Every event of tasks(task, ts, tie, state) with its place in the task's history and whether it ends the task.

    A history is forgotten ``ttl_s`` seconds of event time after its last event; the next event begins a new one. Events
    later than the watermark of the same length are dropped. Needs the RocksDB state store.
    """
    task = dict(events.dtypes)["task"]
    return (
        events.withWatermark("ts", f"{ttl_s} seconds")
        .withColumn("at_us", F.unix_micros("ts"))
        .groupBy("task")
        .transformWithStateInPandas(TaskHistory(ttl_s), HISTORY.format(task=task), "append", "eventTime")
    )


def task_history(events: DataFrame, ttl_s: int = 600, bin_s: int = 86_400) -> DataFrame:
    """The batch twin: ``(task, seq, at_us, state, terminal)``, numbered through bins of time, so no task is one sort."""
    at = events.select("task", F.unix_micros("ts").alias("at_us"), "tie", "state")
    bin_ = F.floor(F.col("at_us") / (bin_s * 1_000_000))
    before = previous(at, ["task"], ["at_us", "tie"], bin_, "at_us", "_before")
    opens = F.coalesce(F.col("at_us") > F.col("_before") + ttl_s * 1_000_000, F.lit(True)).cast("int")
    order = [F.col("at_us"), F.col("tie")]
    parts = running(before, ["task"], order, bin_, {"_part": ("sum", opens)})
    numbered = running(parts, ["task", "_part"], order, bin_, {"seq": ("sum", F.lit(1))})
    return numbered.select("task", F.col("seq").cast("int").alias("seq"), "at_us", "state", F.col("state").isin(*TERMINAL).alias("terminal"))


def ingest_chunks(docs: DataFrame, ascii_edges: bool = False) -> DataFrame:
    """Documents to scrubbed blocks with their ids; the same function serves batches and streams. See ``scrub_pii``."""
    blocks = C.text_blocks(docs.select("doc_id", "source", "text"))
    ids = C.chunk_id(*[F.col(c) for c in ("doc_id", "source", "page", "block_index", "text")])
    return blocks.withColumn("chunk_id", ids).withColumn("text", X.scrub_pii(F.col("text"), ascii_edges=ascii_edges)).select("chunk_id", "doc_id", "source", "block_index", "text")


CHUNK = "chunk_id string, doc_id long, source string, block_index int, text string, prefix string"


def stored_chunks(index: TextIndex, prefixes: list[str] | None = None) -> DataFrame:
    """Chunks of committed batches; with ``prefixes`` only those partitions are read."""
    rows = index.table("chunks", CHUNK, replaced=True)
    return rows if prefixes is None else rows.where(F.col("prefix").isin(prefixes))


def ingest_batch(docs: DataFrame, index: TextIndex, segment: str, prefix: int = 1, most_segments: int = 16) -> bool:
    """Clean, cut, scrub and index documents as one segment: chunks, postings and hashed vectors appear together.

    A chunk whose id is stored already is skipped; only the partitions of the batch's own id prefixes (hex digits) are
    read for that. A batch whose segment is committed adds nothing, and one that failed half-way is written again.
    Segments beyond ``most_segments`` are merged.
    """
    if index.committed(segment):
        return False
    chunks = ingest_chunks(docs).dropDuplicates(["chunk_id"]).withColumn("prefix", F.substring("chunk_id", 1, prefix))
    chunks = written(chunks, "chunks")
    own = sorted(r.prefix for r in chunks.select("prefix").distinct().collect())  # at most 16 ** prefix
    known = stored_chunks(index, own).select("prefix", "chunk_id")
    fresh = written(chunks.join(known, ["prefix", "chunk_id"], "left_anti"), "fresh")
    fresh.write.mode("overwrite").partitionBy("prefix").parquet(f"{index.path}/chunks/segment={segment}")
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))
    vectors = V.hash_embed(fresh, "chunk_id", tokens).withColumnRenamed("chunk_id", "key")
    index.add(segment, fresh, "chunk_id", "text", vectors)
    if len(index.segments()) > most_segments:
        index.compact(f"merged_{segment}")
    return True


def incremental_ingest(docs: DataFrame, index: TextIndex, checkpoint: str, name: str = "batch") -> StreamingQuery:
    """Ingest arriving documents into a search index with string keys; see ``ingest_batch``.

    The checkpoint numbers the batches, so a batch that is replayed after a failure finds its segment committed. Streams
    with checkpoints of their own need names of their own.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        ingest_batch(batch, TextIndex(batch.sparkSession, index.path, index.key_type), f"{name}_{epoch}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
