"""Registered aggregates: A1-A4, A7-A13, A17-A20, A23, A24, A27, A28, A32, A35, A38."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import aggregates as A
from leafmill.operators import nearduplicates as ND
from leafmill.operators import chunking as C
from leafmill.operators.filters import grading_action
from leafmill.operators.running import percentiles
from leafmill.plans.sqlparts import BLOCKS
from leafmill.registry import query
from leafmill.sources.tables import Tables

METRICS_SQL = """m as (select user_id as workspace_id, ts, value * 100 as latency_ms, value / 500 as confidence,
  (props->>'k')::double / 100 as relevance, (props->>'k')::double as answer_length, (event_id % 8)::double as retrieval_count,
  case when event_id % 4 = 0 then null else value / 100 end as faithfulness, event_type = 'click' as web_search,
  event_type = 'error' as human_review, event_type as action from events)"""


def metrics(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return t.events.select(
        F.col("user_id").alias("workspace_id"),
        "ts",
        (F.col("value") * 100).alias("latency_ms"),
        (F.col("value") / 500).alias("confidence"),
        (k / 100).alias("relevance"),
        k.alias("answer_length"),
        (F.col("event_id") % 8).cast("double").alias("retrieval_count"),
        F.when(F.col("event_id") % 4 != 0, F.col("value") / 100).alias("faithfulness"),
        (F.col("event_type") == "click").alias("web_search"),
        (F.col("event_type") == "error").alias("human_review"),
        F.col("event_type").alias("action"),
    )


@query(
    "window_stats",
    "A1",
    f"""with {METRICS_SQL}, w as (select * from m where ts > (select max(ts) from events) - interval 1000 hours),
x as (select workspace_id, string_agg(action || '=' || n, ',' order by action || '=' || n) as action_mix from
  (select workspace_id, action, count(*) as n from w group by all) group by 1)
select workspace_id, count(*) as query_count, round(round(avg(latency_ms), 9), 1) as latency_ms_mean, round(round(avg(confidence), 9), 4) as confidence_mean,
  round(round(avg(relevance), 9), 4) as relevance_mean, round(round(avg(answer_length), 9), 1) as answer_length_mean, round(round(avg(retrieval_count), 9), 2) as retrieval_count_mean,
  round(round(avg(faithfulness), 9), 4) as faithfulness_mean, round(round(avg(web_search::int), 9), 4) as web_search_rate, round(round(avg(human_review::int), 9), 4) as human_review_rate,
  round(round(case when count(*) < 2 then 0 else quantile_cont(latency_ms, 0.5) end, 9), 1)::double as latency_ms_p50,
  round(round(case when count(*) < 2 then 0 else quantile_cont(latency_ms, 0.95) end, 9), 1)::double as latency_ms_p95,
  round(round(case when count(*) < 2 then 0 else quantile_cont(latency_ms, 0.99) end, 9), 1)::double as latency_ms_p99,
  case when count(*) < 2 then 0 else quantile_cont(latency_ms, 0.95) end > 8000 as latency_alert,
  any_value(action_mix) as action_mix, coalesce(avg(faithfulness) < 0.7, false) as faithfulness_alert, 1000.0::double as window_hours
from w join x using (workspace_id) group by workspace_id""",
)
def window_stats(t: Tables) -> DataFrame:
    return A.window_stats(metrics(t), t.events.select(F.max("ts")).scalar(), 1000.0)


def _nan_values():
    k = F.get_json_object("props", "$.k").cast("int")
    return F.when(k < 20, F.lit(float("nan"))).otherwise(F.col("value"))


@query(
    "percentile_linear",
    "A2",
    """select event_type, count(value) as n_values, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95,
  round(quantile_cont(value, 0.99), 6) as p99 from events where (props->>'k')::int >= 20 group by event_type""",
)
def percentile_linear(t: Tables) -> DataFrame:
    # values with a small k become NaN: they must not count
    ev = t.events.withColumn("value", _nan_values())
    p = percentiles(ev, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return p.select("event_type", "n_values", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


@query(
    "percentile_nearest",
    "A3",
    """with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events)
select event_type, max(n) as n_values, max(case when i = least(n * 95 // 100, n - 1) then value end) as p95,
 max(case when i = least(n * 99 // 100, n - 1) then value end) as p99 from r group by event_type""",
)
def percentile_nearest(t: Tables) -> DataFrame:
    return percentiles(t.events, ["event_type"], "value", {"p95": 0.95, "p99": 0.99}, method="nearest")


@query(
    "safe_mean",
    "A4",
    "select event_type, round(avg(value), 6) as mean_value from events where (props->>'k')::int >= 20 group by 1",
)
def safe_mean(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.avg(A.clean(_nan_values())), 6).alias("mean_value"))


@query(
    "platform_overview",
    "A7",
    """select (select count(*) from customer) as n_workspaces, (select count(*) from customer where c_acctbal > 0) as n_active,
 (select count(*) from supplier) as n_users, (select count(*) from documents) as n_docs, (select count(*) from orders) as n_answers,
 (select count(*) from lineitem) as n_citations, (select count(*) from events) as n_events,
 (select count(*) from events where ts > (select max(ts) from events) - interval 24 hours) as n_events_24h,
 (select round(sum(o_totalprice), 2) from orders) as revenue""",
)
def platform_overview(t: Tables) -> DataFrame:
    def n(df: DataFrame):
        return df.select(F.count("*")).scalar()

    now = t.events.select(F.max("ts")).scalar()
    return t.spark.range(1).select(
        n(t.customer).alias("n_workspaces"),
        n(t.customer.where("c_acctbal > 0")).alias("n_active"),
        n(t.supplier).alias("n_users"),
        n(t.documents).alias("n_docs"),
        n(t.orders).alias("n_answers"),
        n(t.lineitem).alias("n_citations"),
        n(t.events).alias("n_events"),
        n(t.events.where(F.col("ts") > now - F.expr("interval 24 hours"))).alias("n_events_24h"),
        t.orders.select(F.round(F.sum("o_totalprice"), 2)).scalar().alias("revenue"),
    )


@query(
    "daily_counts",
    "A8",
    """select user_id, ts::date as day, count(*) as n from events
where ts > (select max(ts) from events) - interval 30 days group by all""",
)
def daily_counts(t: Tables) -> DataFrame:
    now = t.events.select(F.max("ts")).scalar()
    return (
        t.events.where(F.col("ts") > now - F.expr("interval 30 days"))
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "onboarding_flags",
    "A9",
    """select c_custkey, exists (select 1 from orders where o_custkey = c_custkey) as has_query,
  exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F') as has_answer,
  exists (select 1 from events where user_id = c_custkey) as has_member,
  exists (select 1 from events where user_id = c_custkey and event_type = 'purchase') as has_key from customer""",
)
def onboarding_flags(t: Tables) -> DataFrame:
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("q"), F.count_if(F.col("o_orderstatus") == "F").alias("a")
    )
    e = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.count("*").alias("m"), F.count_if(F.col("event_type") == "purchase").alias("k")
    )
    j = t.customer.select("c_custkey").join(o, "c_custkey", "left").join(e, "c_custkey", "left")
    names = {"q": "has_query", "a": "has_answer", "m": "has_member", "k": "has_key"}
    return j.select("c_custkey", *[(F.coalesce(c, F.lit(0)) >= 1).alias(n) for c, n in names.items()])


@query(
    "citation_stats",
    "A10",
    f"""with {BLOCKS}, p as (select source, page, count(*) as n, round(round(sum(length(text))::double / count(*) / 1000, 9), 3) as mean_confidence from blocks group by all)
select source, page, n, mean_confidence, sum(n) over (partition by source)::bigint as total from p""",
)
def citation_stats(t: Tables) -> DataFrame:
    pages = (
        C.text_blocks(t.documents)
        .groupBy("source", "page")
        .agg(F.count("*").alias("n"), A.tidy(F.sum(F.length("text")) / F.count("*") / 1000, 3).alias("mean_confidence"))
    )
    totals = pages.groupBy("source").agg(F.sum("n").alias("total"))
    return pages.join(totals, "source")


@query(
    "document_registry",
    "A11",
    f"""with {BLOCKS} select source, arg_min(lang, (doc_id, block_index)) as language, max(page) + 1 as n_pages, count(*) as n_chunks,
 round(avg(length(text) / 1000.0), 3) as mean_confidence, min(doc_id) as first_doc from blocks group by source""",
)
def document_registry(t: Tables) -> DataFrame:
    return (
        C.text_blocks(t.documents)
        .groupBy("source")
        .agg(
            F.min_by("lang", F.struct("doc_id", "block_index")).alias("language"),
            (F.max("page") + 1).alias("n_pages"),
            F.count("*").alias("n_chunks"),
            F.round(F.avg(F.length("text") / 1000.0), 3).alias("mean_confidence"),
            F.min("doc_id").alias("first_doc"),
        )
    )


@query(
    "chunk_stats",
    "A12",
    f"""with {BLOCKS}, c as (select doc_id, block_index, substr(text, s + 1, 200) as text from
   (select *, unnest(range(0, length(text), 150)) as s from blocks)),
p as (select doc_id, block_index, count(*) as n from c group by all)
select count(*) as n_chunks, sum(length(text))::bigint as total_chars, min(length(text)) as min_chars, max(length(text)) as max_chars,
 round(avg(length(text)), 2) as avg_chars, (select round(avg(n), 4) from p) as children_per_parent,
 round(sum(length(text)) * 2 / 1048576.0, 4) as memory_mb from c""",
)
def chunk_stats(t: Tables) -> DataFrame:
    kids = C.fixed_windows(C.text_blocks(t.documents).select("doc_id", "block_index", "text"), 200, 50)
    n = F.length("text")
    per_parent = kids.groupBy("doc_id", "block_index").agg(
        F.count("*").alias("n"), F.sum(n).alias("c"), F.min(n).alias("lo"), F.max(n).alias("hi")
    )
    return per_parent.agg(
        F.sum("n").alias("n_chunks"),
        F.sum("c").alias("total_chars"),
        F.min("lo").cast("bigint").alias("min_chars"),
        F.max("hi").cast("bigint").alias("max_chars"),
        F.round(F.sum("c") / F.sum("n"), 2).alias("avg_chars"),
        F.round(F.avg("n"), 4).alias("children_per_parent"),
        F.round(F.sum("c") * 2 / 1048576.0, 4).alias("memory_mb"),
    )


@query(
    "exact_duplicates",
    "A13",
    f"""with {BLOCKS}, f as (select doc_id, md5(string_agg(h, '|' order by h)) as fp from (select distinct doc_id, md5(text) as h from blocks) group by 1),
g as (select fp, count(*) as n_files, min(doc_id) as first_file from f group by 1 having count(*) > 1)
select doc_id, n_files, first_file from f join g using (fp)""",
)
def exact_duplicates(t: Tables) -> DataFrame:
    return A.exact_duplicates(C.text_blocks(t.documents), "doc_id", "text").drop("fingerprint")


@query(
    "near_duplicates",
    "A36",
    r"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
sh as (select distinct doc_id, unnest(case when len(ws) = 0 then []::varchar[] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as s from w),
sets as (select doc_id, count(s) as n, coalesce(md5(string_agg(s, chr(10) order by s)), '') as h from w left join sh using (doc_id) group by 1),
cl as (select h, min(doc_id) as same_as, count(*) as n_copies, any_value(n) as n from sets group by 1),
v as (select same_as as id, s from cl join sh on doc_id = same_as),
pairs as (select a.id as a, b.id as b, count(*) as c from v a join v b on a.s = b.s and a.id <> b.id group by all),
e as (select a, b from pairs join cl x on x.same_as = a join cl y on y.same_as = b where c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach as (select same_as as id, same_as as via from cl union select id, b from reach join e on a = via),
g as (select id, min(via) as "group" from reach group by 1)
select doc_id, same_as, n_copies, "group", count(*) over (partition by "group") as n_group
from (select doc_id, h from sets) join cl using (h) join g on id = same_as""",
)
def near_duplicates(t: Tables) -> DataFrame:
    return ND.near_duplicates(t.documents, threshold=0.8)


@query(
    "compliance_summary",
    "A17",
    """with r as (select o_orderkey, (o_orderkey % 100)::double as gdpr, (o_custkey % 100)::double as hipaa,
  case when o_orderkey % 3 = 0 then (o_orderkey % 50)::double end as given, o_orderkey % 4 as nv from orders)
select o_orderkey, coalesce(given, (gdpr + hipaa) / 2) as overall, nv as n_violations,
  (case when nv > 0 then 1 else 0 end + case when nv > 2 then 1 else 0 end)::bigint as n_high, greatest(nv - 1, 0) - case when nv > 2 then 1 else 0 end as n_medium from r""",
)
def compliance_summary(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    violations = F.when(k % 4 == 0, "[]").when(k % 4 == 1, '["high"]').when(k % 4 == 2, '["high","medium"]').otherwise(
        '["high","medium","high"]'
    )
    given = F.when(k % 3 == 0, F.format_string(',"overall_score":%d', k % 50)).otherwise("")
    js = F.format_string(
        '{"scores":{"gdpr":%d,"hipaa":%d}%s,"violations":%s}', k % 100, F.col("o_custkey") % 100, given, violations
    )
    parsed = F.from_json(js, "scores map<string,double>, overall_score double, violations array<string>")
    r = t.orders.select("o_orderkey", parsed.alias("j"))
    vals = F.map_values("j.scores")
    mean = F.aggregate(vals, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(vals), F.lit(1))

    def n(level: str):
        return F.size(F.filter("j.violations", lambda v: v == level)).cast("bigint")

    return r.select(
        "o_orderkey",
        F.coalesce("j.overall_score", mean).alias("overall"),
        F.size("j.violations").cast("bigint").alias("n_violations"),
        n("high").alias("n_high"),
        n("medium").alias("n_medium"),
    )


_PAIR_SQL = """a as (select o_orderkey as k, unnest(['status', 'total', 'priority']) as field,
   unnest([o_orderstatus, (o_totalprice * 100)::bigint::varchar, o_orderpriority]) as value from orders where o_orderpriority <> '5-LOW'),
b as (select o_orderkey as k, unnest(['status', 'total', 'priority']) as field,
   unnest([case when o_custkey % 5 = 0 then 'X' else o_orderstatus end, (o_totalprice * 100 + (o_custkey % 3 = 0)::int)::bigint::varchar, o_orderpriority]) as value
   from orders where o_orderpriority <> '1-URGENT')"""


@query(
    "discrepancy_report",
    "A18",
    f"""with {_PAIR_SQL}
select field, case when field = 'total' then 'high' else 'medium' end as severity, count(*) as n,
 count(*) filter (a.value is null or b.value is null) as n_not_found
from a full join b using (k, field) where a.value is distinct from b.value group by all""",
)
def discrepancy_report(t: Tables) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    o = t.orders.withColumn("cents", cents)

    def fields(df, status, total):
        wide = df.select(
            F.col("o_orderkey").alias("k"), status.alias("status"), total.cast("string").alias("total"), F.col("o_orderpriority").alias("priority")
        )
        return wide.unpivot(["k"], ["status", "total", "priority"], "field", "value")

    a = fields(o.where("o_orderpriority <> '5-LOW'"), F.col("o_orderstatus"), F.col("cents"))
    b = fields(
        o.where("o_orderpriority <> '1-URGENT'"),
        F.when(F.col("o_custkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")),
        F.col("cents") + (F.col("o_custkey") % 3 == 0).cast("int"),
    )
    missing = (F.col("value_a") == "Not found") | (F.col("value_b") == "Not found")
    return (
        A.discrepancies(a, b, ["k"], ["total"])
        .groupBy("field", "severity")
        .agg(F.count("*").alias("n"), F.count_if(missing).alias("n_not_found"))
    )


@query(
    "year_over_year",
    "A19",
    """with c as (select o_custkey, round(sum(o_totalprice), 2) as v from orders where year(o_orderdate) = 2000 group by 1),
p as (select o_custkey, round(sum(o_totalprice), 2) as v from orders where year(o_orderdate) = 1999 group by 1)
select o_custkey, c.v as current, p.v as previous, case when p.v is null then 'New' when c.v is null then 'Removed' when c.v = p.v then 'Same'
 else format('{:.2f}%', round((c.v - p.v) / p.v * 100, 2)) end as change from c full join p using (o_custkey)""",
)
def year_over_year(t: Tables) -> DataFrame:
    def year(y: int) -> DataFrame:
        rows = t.orders.where(
            (F.col("o_orderdate") >= F.expr(f"timestamp_ntz'{y}-01-01'")) & (F.col("o_orderdate") < F.expr(f"timestamp_ntz'{y + 1}-01-01'"))
        )
        return rows.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("value"))

    return A.year_over_year(year(2000), year(1999), "o_custkey")


@query(
    "grading_action",
    "A20",
    """with g as (select conv_id, length(text) % 3 as g, length(text) % 100 / 100.0 as s from conversations),
a as (select conv_id, count(*) as n, count(*) filter (g = 0) as relevant, count(*) filter (g = 1) as irrelevant, count(*) filter (g = 2) as ambiguous,
  round(avg(s), 6) as mean_score from g group by 1)
select conv_id, relevant, irrelevant, ambiguous, mean_score, case when relevant / n >= 0.6 then 'generate' when relevant > 0 and ambiguous > 0 then 'decompose'
  when relevant > 0 then 'filter_and_supplement' else 'rewrite' end as action from a""",
)
def grade_turns(t: Tables) -> DataFrame:
    g = F.length("text") % 3
    a = t.conversations.groupBy("conv_id").agg(
        F.count("*").alias("n"),
        F.count_if(g == 0).alias("relevant"),
        F.count_if(g == 1).alias("irrelevant"),
        F.count_if(g == 2).alias("ambiguous"),
        F.round(F.avg(F.length("text") % 100 / 100.0), 6).alias("mean_score"),
    )
    return a.withColumn("action", grading_action(F.col("relevant"), F.col("ambiguous"), F.col("n"))).drop("n")


@query(
    "cache_rates",
    "A23",
    """with h as (select (event_id % 3) as level, value > 50 as hit from events)
select coalesce(level::varchar, 'all') as level, count(*) as n, round(avg(hit::int), 3) as hit_rate from h group by grouping sets ((level), ())""",
)
def cache_rates(t: Tables) -> DataFrame:
    h = t.events.select((F.col("event_id") % 3).cast("string").alias("level"), (F.col("value") > 50).cast("int").alias("hit"))
    per = h.groupBy("level").agg(F.count("*").alias("n"), F.sum("hit").alias("h"))
    both = per.unionByName(per.agg(F.sum("n").alias("n"), F.sum("h").alias("h")).withColumn("level", F.lit("all")))
    return both.select("level", "n", F.round(F.when(F.col("n") > 0, F.col("h") / F.col("n")).otherwise(0.0), 3).alias("hit_rate"))


@query(
    "benchmark_summary",
    "A24",
    """with r as (select event_type as method, case when value >= 2 then value end as ms from events),
o as (select method, ms, row_number() over (partition by method order by ms) - 1 as i, count(*) over (partition by method) as n from r where ms is not null)
select r.method, (select round(avg(ms), 6) from r q where q.method = r.method) as mean_ms,
 (select max(ms) from o where o.method = r.method and i = least(n * 95 // 100, n - 1)) as p95,
 (select max(ms) from o where o.method = r.method and i = least(n * 99 // 100, n - 1)) as p99,
 round(count(ms) / count(*), 6) as success_rate, count(*) as total_queries from r group by r.method""",
)
def benchmark_summary(t: Tables) -> DataFrame:
    r = t.events.select(F.col("event_type").alias("method"), F.when(F.col("value") >= 2, F.col("value")).alias("ms"))
    base = r.groupBy("method").agg(
        F.round(F.avg("ms"), 6).alias("mean_ms"),
        F.round(F.count("ms") / F.count("*"), 6).alias("success_rate"),
        F.count("*").alias("total_queries"),
    )
    return base.join(percentiles(r, ["method"], "ms", {"p95": 0.95, "p99": 0.99}, "nearest").drop("n_values"), "method")


@query(
    "ocr_doc_metrics",
    "A27",
    f"""with {BLOCKS}, p as (select source, page, length(text) % 50 / 50.0 as cer, length(text) % 30 / 30.0 as wer, length(text) / 3000.0 as conf, length(text) < 60 as fb from blocks)
select source, count(*) as n_pages, round(avg(cer), 4) as mean_cer, round(avg(wer), 4) as mean_wer, round(avg(conf), 4) as mean_confidence,
 round(avg(fb::int), 4) as fallback_rate, round(1 - avg(cer), 4) as accuracy_cer, round(1 - avg(wer), 4) as accuracy_wer from p group by source""",
)
def ocr_doc_metrics(t: Tables) -> DataFrame:
    n = F.length("text")
    p = C.text_blocks(t.documents).select(
        "source", (n % 50 / 50.0).alias("cer"), (n % 30 / 30.0).alias("wer"), (n / 3000.0).alias("conf"), (n < 60).alias("fb")
    )
    return p.groupBy("source").agg(
        F.count("*").alias("n_pages"),
        F.round(F.avg("cer"), 4).alias("mean_cer"),
        F.round(F.avg("wer"), 4).alias("mean_wer"),
        F.round(F.avg("conf"), 4).alias("mean_confidence"),
        F.round(F.avg(F.col("fb").cast("int")), 4).alias("fallback_rate"),
        F.round(1 - F.avg("cer"), 4).alias("accuracy_cer"),
        F.round(1 - F.avg("wer"), 4).alias("accuracy_wer"),
    )


@query(
    "confidence_distribution",
    "A28",
    """with c as (select event_type, least(value / 100, 1.0) as c from events)
select event_type, round(avg(c), 4) as mean, round(median(c), 4) as median, round(stddev_pop(c), 4) as std, round(min(c), 4) as min, round(max(c), 4) as max,
 round(avg((c >= 0.9)::int), 4) as above_90, round(avg((c >= 0.85)::int), 4) as above_85, round(avg((c < 0.7)::int), 4) as below_70 from c group by 1""",
)
def confidence_distribution(t: Tables) -> DataFrame:
    c = F.col("c")
    df = t.events.select("event_type", F.least(F.col("value") / 100, F.lit(1.0)).alias("c"))
    base = df.groupBy("event_type").agg(
        F.round(F.avg(c), 4).alias("mean"),
        F.round(F.stddev_pop(c), 4).alias("std"),
        F.round(F.min(c), 4).alias("min"),
        F.round(F.max(c), 4).alias("max"),
        F.round(F.avg((c >= 0.9).cast("int")), 4).alias("above_90"),
        F.round(F.avg((c >= 0.85).cast("int")), 4).alias("above_85"),
        F.round(F.avg((c < 0.7).cast("int")), 4).alias("below_70"),
    )
    med = percentiles(df, ["event_type"], "c", {"median": 0.5}, min_n=1).select("event_type", F.round("median", 4).alias("median"))
    return base.join(med, "event_type")


@query(
    "medication_unique",
    "A32",
    """with m as (select l_suppkey, l_orderkey, l_linenumber, l_partkey, case when l_linenumber % 2 = 0 then upper(p_name) else p_name end as name, p_size
  from lineitem join part on p_partkey = l_partkey),
r as (select *, row_number() over (partition by l_suppkey, lower(name) order by l_orderkey, l_linenumber, l_partkey, name, p_size) as rn from m)
select l_suppkey, lower(name) as folded, name, l_orderkey, l_linenumber, l_partkey, p_size from r where rn = 1""",
)
def medication_unique(t: Tables) -> DataFrame:
    m = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(
        "l_suppkey",
        F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "p_size",
    )
    return A.first_per_name(m, "l_suppkey", "name", ["l_orderkey", "l_linenumber", "l_partkey"])


@query(
    "task_stats",
    "A35",
    """with e as (select case event_type when 'view' then 'pending' when 'click' then 'running' when 'error' then 'failed' else 'completed' end as status,
  case when event_id % 10 = 0 then 'undated' else strftime(ts, '%Y-%m-%d %H:%M:%S') end as created from events),
d as (select status, try_cast(created as timestamp) as made from e)
select status, count(*) as n from d where made >= (select max(ts) from events) - interval 24 hours group by status""",
)
def task_stats(t: Tables) -> DataFrame:
    status = F.lit("completed")
    for ev, s in (("view", "pending"), ("click", "running"), ("error", "failed")):
        status = F.when(F.col("event_type") == ev, s).otherwise(status)
    created = F.when(F.col("event_id") % 10 == 0, "undated").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    at = created.try_cast("timestamp_ntz")
    now = t.events.select(F.max("ts")).scalar()
    return (
        t.events.select(status.alias("status"), at.alias("at"))
        .where(F.col("at") >= now - F.expr("interval 24 hours"))
        .groupBy("status")
        .agg(F.count("*").alias("n"))
    )


@query(
    "tenant_footprint",
    "A38",
    f"""with {BLOCKS}, c as (select source, count(*) as n_chunks from blocks group by 1), d as (select source, count(*) as n_docs from documents group by 1),
e as (select source, count(*) as n_labels from documents join labels using (doc_id) group by 1)
select source, coalesce(n_chunks, 0) as n_chunks, coalesce(n_docs, 0) as n_docs, coalesce(n_labels, 0) as n_labels
from c full join d using (source) full join e using (source)""",
)
def tenant_footprint(t: Tables) -> DataFrame:
    c = C.text_blocks(t.documents).groupBy("source").agg(F.count("*").alias("n_chunks"))
    d = t.documents.groupBy("source").agg(F.count("*").alias("n_docs"))
    e = t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.count("*").alias("n_labels"))
    return c.join(d, "source", "full").join(e, "source", "full").na.fill(0)
