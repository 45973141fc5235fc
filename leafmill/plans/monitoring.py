"""Registered monitoring decisions: D1-D5."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import aggregates as A
from leafmill.operators import monitoring as M
from leafmill.plans.aggregating import METRICS_SQL, metrics
from leafmill.registry import query
from leafmill.sources.tables import Tables

_COLS = ["latency_ms", "confidence", "relevance", "answer_length", "retrieval_count"]


def _parts(t: Tables) -> DataFrame:
    now = t.events.select(F.max("ts")).scalar()
    age = now - F.col("ts")
    m = metrics(t).withColumn("confidence", F.col("confidence") * F.when(age < F.expr("interval 15 days"), 1.3).otherwise(1.0))
    return m.withColumn("part", F.when(age < F.expr("interval 15 days"), "current").otherwise("reference"))


@query(
    "ks_drift",
    "D1",
    f"""with {METRICS_SQL}, x as (select *, ts > (select max(ts) from events) - interval 15 days as cur from m),
u as (select unnest(['latency_ms', 'confidence', 'relevance', 'answer_length', 'retrieval_count']) as col, unnest([latency_ms, confidence * case when cur then 1.3 else 1.0 end::double, relevance, answer_length, retrieval_count]) as v, cur from x),
g as (select col, v, count(*) filter (cur) as c, count(*) filter (not cur) as r from u group by all),
w as (select col, sum(c) over (partition by col order by v) as cc, sum(r) over (partition by col order by v) as cr, sum(c) over (partition by col) as tc, sum(r) over (partition by col) as tr from g),
d as (select col, max(tc)::bigint as n1, max(tr)::bigint as n2, max(abs(cc / tc - cr / tr)) as d from w group by 1),
e as (select *, (sqrt(n1 * n2 / (n1 + n2)) + 0.12::double + 0.11::double / sqrt(n1 * n2 / (n1 + n2))) * d as x from d),
p as (select col, n1, n2, d, case when x < 0.2 then 1.0 else greatest(0, least(1, 2 * (select sum(case when k % 2 = 1 then 1.0::double else -1.0::double end * exp(-2.0::double * k * k * x * x)) from range(1, 101) t(k)))) end as p from e)
select col as "column", n1 as n_current, n2 as n_reference, round(d, 6) as drift_score, round(p, 4)::double as p_value, p < 0.05 as drift_detected from p""",
)
def ks_drift(t: Tables) -> DataFrame:
    return M.ks_drift(_parts(t), _COLS)


@query(
    "metric_features",
    "D2",
    """select event_id, value * 100 as latency_ms, value / 500 as confidence, (props->>'k')::double as answer_length, (event_id % 8)::double as retrieval_count,
 (event_type = 'click')::int::double as web_search, (event_type = 'view')::int::double as action_view, (event_type = 'purchase')::int::double as action_purchase,
 case when event_id % 4 = 0 then 'nan'::double else value / 100 end as faithfulness from events where event_type <> 'signup'""",
)
def metric_features(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    ev = t.events.select(
        "event_id",
        F.when(F.col("event_type") != "signup", F.col("value") * 100).alias("latency_ms"),
        (F.col("value") / 500).alias("confidence"),
        k.alias("answer_length"),
        (F.col("event_id") % 8).alias("retrieval_count"),
        (F.col("event_type") == "click").alias("web_search"),
        F.col("event_type").alias("action"),
        F.when(F.col("event_id") % 4 != 0, F.col("value") / 100).alias("faithfulness"),
    )
    return M.metric_features(ev, ["view", "purchase"])


_STATS = f"""{METRICS_SQL}, st as (select workspace_id, round(round(avg(confidence), 9), 4) as confidence_mean, round(round(avg(relevance), 9), 4) as relevance_mean, round(round(avg(faithfulness), 9), 4) as faithfulness_mean,
  round(avg(web_search::int), 4) as web_search_rate, round(avg(human_review::int), 4) as human_review_rate, round(round(quantile_cont(latency_ms, 0.95), 9), 1) as latency_ms_p95 from m group by 1),
al as (select * from (select workspace_id, unnest(['confidence_mean', 'relevance_mean', 'faithfulness_mean', 'web_search_rate', 'human_review_rate', 'latency_ms_p95']) as metric,
   unnest([confidence_mean, relevance_mean, faithfulness_mean, web_search_rate, human_review_rate, latency_ms_p95]) as value,
   unnest([0.65, 0.60, 0.70, 0.40, 0.20, 8000.0])::double as threshold, unnest([false, false, false, true, true, true]) as high from st) where case when high then value > threshold else value < threshold end)"""


def stats(t: Tables) -> DataFrame:
    return A.window_stats(metrics(t), t.events.select(F.max("ts")).scalar(), 720.0)


@query(
    "quality_alerts",
    "D3",
    f"""with {_STATS} select workspace_id, metric, value, threshold, metric || ': ' || format('{{:.3f}}', value + 1e-9) || case when high then ' exceeds threshold ' else ' below threshold ' end || threshold as message from al""",
)
def quality_alerts(t: Tables) -> DataFrame:
    return M.quality_alerts(stats(t), ["workspace_id"])


_ADVICE = " ".join(f"when '{m}' then {i}" for i, (m, _) in enumerate(M.ADVICE))
_TEXTS = " ".join(f"when '{m}' then '{x}'" for m, x in M.ADVICE)


@query(
    "recommendations",
    "D4",
    f"""with {_STATS}, w as (select distinct workspace_id from al), x as (select workspace_id, metric from al union all select workspace_id, 'drift:confidence' from w),
y as (select workspace_id, case metric {_ADVICE} end as o, case metric {_TEXTS} end as txt from x)
select workspace_id, coalesce(string_agg(txt, '; ' order by o), '') as advice from y where o is not null group by 1""",
)
def recommendations(t: Tables) -> DataFrame:
    alerts = M.quality_alerts(stats(t), ["workspace_id"])
    r = M.recommendations(alerts, ["workspace_id"], F.array(F.lit("confidence")))
    return r.select("workspace_id", F.array_join("advice", "; ").alias("advice"))


@query(
    "improvement_action",
    "D5",
    f"""with {_STATS} select workspace_id, case when faithfulness_mean < 0.70::double - 0.15::double then 'rechunk' when faithfulness_mean < 0.70 then 're_embed'
  when latency_ms_p95 > 8000 or relevance_mean < 0.55 then 'retune_retrieval' else 'alert_only' end as action from st""",
)
def improvement_action(t: Tables) -> DataFrame:
    a = M.improvement_action(F.col("faithfulness_mean"), F.col("latency_ms_p95"), F.col("relevance_mean"), F.lit(False))
    return stats(t).select("workspace_id", a.alias("action"))
