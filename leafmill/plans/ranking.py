"""Registered ranks and windows: K1-K4, W1-W5, W7."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import ranking as R
from leafmill.registry import query
from leafmill.sources.tables import Tables


@query("top_k", "K1", "select event_id, value from events order by value desc, event_id limit 500")
def top_k(t: Tables) -> DataFrame:
    return R.top_k(t.events.select("event_id", "value"), "value", "event_id", 500)


@query(
    "top_k_per_query",
    "K2",
    """select user_id, event_id, value, rank::int as rank from (select *, row_number() over (partition by user_id order by value desc, event_id) as rank from events) where rank <= 10""",
)
def top_k_per_query(t: Tables) -> DataFrame:
    return R.top_k_per_key(t.events.select("user_id", "event_id", "value"), ["user_id"], "value", "event_id", 10)


@query("page", "K3", "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 20 offset 200")
def page(t: Tables) -> DataFrame:
    return R.page(t.orders.select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), "o_orderkey"], 20, 200)


@query(
    "threshold_top_k",
    "K4",
    """select user_id, event_id, value, rank::int as rank from (select *, row_number() over (partition by user_id order by value desc, event_id) as rank from events where value >= 50) where rank <= 5""",
)
def threshold_top_k(t: Tables) -> DataFrame:
    return R.threshold_top_k(t.events.select("user_id", "event_id", "value"), ["user_id"], "value", "event_id", 5, 50.0)


@query(
    "rank_list",
    "W1",
    "select event_type, event_id, value, row_number() over (partition by event_type order by value desc, event_id)::int as rank from events",
)
def rank_list(t: Tables) -> DataFrame:
    return R.rank_list(t.events.select("event_type", "event_id", "value"), ["event_type"], "value", "event_id")


_WINDOW_S = 3 * 24 * 3600


@query(
    "sliding_rate_limit",
    "W2",
    f"""with r as (select user_id, case event_type when 'view' then 'query' when 'click' then 'ingest' when 'signup' then 'ingest' when 'error' then 'domains' else 'default' end as grp, event_id, epoch_us(ts) as us from events),
c as (select *, count(*) over (partition by user_id, grp order by us range between {_WINDOW_S * 1_000_000 - 1} preceding and current row) as n,
  case grp when 'query' then 100 when 'ingest' then 10 when 'domains' then 50 else 200 end as lim from r)
select user_id, grp, event_id, n as n_in_window, n <= lim as allowed, greatest(lim - n, 0) as remaining, us + {_WINDOW_S * 1_000_000} as reset_at_us,
  case when n <= lim then 0 else {_WINDOW_S} end as retry_after from c""",
)
def sliding_rate_limit(t: Tables) -> DataFrame:
    group = F.lit("default")
    for ev, g in (("view", "query"), ("click", "ingest"), ("signup", "ingest"), ("error", "domains")):
        group = F.when(F.col("event_type") == ev, g).otherwise(group)
    r = t.events.select("user_id", group.alias("grp"), "event_id", "ts")
    return R.sliding_rate_limit(r, ["user_id"], "grp", _WINDOW_S, "event_id")


@query(
    "daily_trend",
    "W3",
    """with d as (select ts::date as day, count(*) as n, round(avg(value), 4) as mean_value from events group by 1)
select day, n, mean_value, n - lag(n) over (order by day) as delta from d""",
)
def daily_trend(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    d = t.events.groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value")
    )
    # one row per day reaches this window
    return d.withColumn("delta", F.col("n") - F.lag("n").over(W.orderBy("day"))).orderBy("day")


@query(
    "version_history",
    "W4",
    """with v as (select source, doc_id, row_number() over (partition by source order by doc_id) as version_no, count(*) over (partition by source) as n_versions,
   lag(text) over (partition by source order by doc_id) as p from documents)
select source, doc_id, version_no, n_versions, n_versions - version_no + 1 as newest_rank, md5(p) as previous_md5 from v""",
)
def version_history(t: Tables) -> DataFrame:
    v = R.version_history(t.documents.select("source", "doc_id", "text"), "source", "doc_id", "text", F.floor(F.col("doc_id") / 1000))
    return v.select("source", "doc_id", "version_no", "n_versions", "newest_rank", F.md5("previous_text").alias("previous_md5"))


@query(
    "cooldown_gate",
    "W5",
    """with recursive a as (select user_id, date_trunc('hour', ts) as fired_at from events group by 1, 2 having avg(value) > 60),
f as (select user_id, min(fired_at) as fired_at from a group by 1
  union all
  select f.user_id, min(a.fired_at) as fired_at from f join a on a.user_id = f.user_id and a.fired_at >= f.fired_at + interval 24 hours group by f.user_id, f.fired_at)
select user_id, fired_at from f""",
)
def cooldown_gate(t: Tables) -> DataFrame:
    runs = t.events.groupBy("user_id", F.date_trunc("hour", F.col("ts")).alias("fired_at")).agg(F.avg("value").alias("v"))
    return R.cooldown_gate(runs.where("v > 60").withColumn("fired_at", F.col("fired_at").cast("timestamp_ntz")), "user_id", "fired_at")


@query(
    "first_last_per_group",
    "W7",
    """select user_id, arg_min(event_type, (ts, event_id)) as first_type, arg_max(event_type, (ts, event_id)) as last_type, max(ts) as last_ts from events group by 1""",
)
def first_last_per_group(t: Tables) -> DataFrame:
    order = F.struct("ts", "event_id")
    return t.events.groupBy("user_id").agg(
        F.min_by("event_type", order).alias("first_type"),
        F.max_by("event_type", order).alias("last_type"),
        F.max("ts").alias("last_ts"),
    )
