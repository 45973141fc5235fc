"""Registered filters: F1-F7, F12, F13."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import filters as L
from leafmill.registry import query
from leafmill.sources.tables import Tables


@query(
    "metadata_filter",
    "F1",
    """select doc_id, source, lang, n_chars from documents
where lang in ('en', 'fr') and source <> 'src3' and n_chars >= 200 and n_chars < 9000 and list_contains([source, lang], lang)""",
)
def metadata_filter(t: Tables) -> DataFrame:
    docs = t.documents.select(
        F.col("doc_id"),
        F.col("source").alias("source_file"),
        F.col("lang").alias("language"),
        F.col("n_chars").alias("page_number"),
        F.array("source", "lang").alias("tags"),
        "lang",
    )
    spec = {
        "language": {"$in": ["en", "fr"]},
        "source_file": {"$ne": "src3"},
        "page_number": {"$gte": 200, "$lt": 9000},
    }
    kept = docs.where(L.metadata_filter(docs, spec, L.ALLOWED_KEYS))
    return kept.where(F.array_contains("tags", F.col("lang"))).select(
        "doc_id", F.col("source_file").alias("source"), F.col("language").alias("lang"), F.col("page_number").alias("n_chars")
    )


@query(
    "metadata_filter_kinds",
    "F2",
    """select 'number_vs_text' as test, count(*) as n from documents where false
union all select 'is_null', count(*) from documents left join labels using (doc_id) where quality is null
union all select 'nin_missing_fails', count(*) from documents left join labels using (doc_id) where quality not in (0)
union all select 'list_member', count(*) from documents where lang = 'de'""",
)
def metadata_filter_kinds(t: Tables) -> DataFrame:
    docs = t.documents.join(t.labels, "doc_id", "left").withColumn("tags", F.array("source", "lang"))
    allowed = (*L.ALLOWED_KEYS, "n_chars", "quality")
    tests = {
        "number_vs_text": {"n_chars": "200"},
        "is_null": {"quality": None},
        "nin_missing_fails": {"quality": {"$nin": [0]}},
        "list_member": {"tags": "de"},
    }
    counts = docs.agg(*[F.count_if(L.metadata_filter(docs, s, allowed)).alias(n) for n, s in tests.items()])
    return counts.unpivot([], list(tests), "test", "n")


@query(
    "coerce_metadata",
    "F3",
    """select event_id, coalesce(try_cast(props->>'k' as int), 0) as page_number,
  case when event_id % 9 = 0 then 0.0 else value end as ocr_confidence, event_type <> 'error' as valid from events""",
)
def coerce_metadata(t: Tables) -> DataFrame:
    raw = t.events.select(
        "event_id",
        F.get_json_object("props", "$.k").alias("page_number"),
        F.when(F.col("event_id") % 9 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("ocr_confidence"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("block_type"),
    )
    return L.coerce_metadata(raw, ["page_number"], ["ocr_confidence"], ["block_type"]).drop("block_type")


RULES = [
    {"name": "big_open", "action": "notify", "conditions": [
        {"field": "o_totalprice", "operator": "gt", "value": 200000}, {"field": "o_orderstatus", "operator": "eq", "value": "o"}]},
    {"name": "urgent", "action": "tag", "conditions": [{"field": "o_orderpriority", "operator": "regex", "value": "^[12]-"}]},
    {"name": "not_medium", "action": "tag", "conditions": [
        {"field": "o_orderpriority", "operator": "not_contains", "value": "MEDIUM"},
        {"field": "o_orderstatus", "operator": "in", "value": ["F", "p"]},
        {"field": "o_totalprice", "operator": "lte", "value": "50000"}]},
    {"name": "always", "action": "log", "conditions": []},
    {"name": "bad_cast", "action": "never", "conditions": [{"field": "o_orderstatus", "operator": "gt", "value": 1}]},
    {"name": "no_field", "action": "never", "conditions": [{"field": "missing", "operator": "neq", "value": 1}]},
]


@query(
    "workflow_rules",
    "F4",
    """select o_orderkey, 'big_open' as rule, 'notify' as action from orders where o_totalprice > 200000 and lower(o_orderstatus) = 'o'
union all select o_orderkey, 'urgent', 'tag' from orders where regexp_matches(o_orderpriority, '^[12]-')
union all select o_orderkey, 'not_medium', 'tag' from orders where not contains(lower(o_orderpriority), 'medium')
  and o_orderstatus in ('F', 'P') and o_totalprice <= 50000
union all select o_orderkey, 'always', 'log' from orders""",
)
def workflow_rules(t: Tables) -> DataFrame:
    return L.workflow_hits(t.orders, RULES, ["o_orderkey"])


@query(
    "document_search",
    "F5",
    """select doc_id, source, lang from documents where lang = 'en' and (text ilike '%tion%' or source ilike '%tion%')
order by doc_id desc limit 50 offset 20""",
)
def document_search(t: Tables) -> DataFrame:
    return L.search(
        t.documents, "tion", ["text", "source"], {"lang": "en", "source": None}, [F.desc("doc_id")], 50, 20
    ).select("doc_id", "source", "lang")


@query(
    "audit_query",
    "F6",
    """select event_id, ts, event_type, user_id, c_name from events left join customer on user_id = c_custkey
where event_type in ('error', 'signup') and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-25'
order by ts desc, event_id limit 100 offset 10""",
)
def audit_query(t: Tables) -> DataFrame:
    users = t.customer.select(F.col("c_custkey").alias("user_id"), "c_name")
    page = (
        t.events.where(F.col("event_type").isin("error", "signup"))
        .where((F.col("ts") >= F.expr("timestamp_ntz'2024-01-05'")) & (F.col("ts") < F.expr("timestamp_ntz'2024-01-25'")))
        .orderBy(F.desc("ts"), "event_id")
        .offset(10)
        .limit(100)
    )
    return page.join(users, "user_id", "left").select("event_id", "ts", "event_type", "user_id", "c_name")


@query(
    "citation_search",
    "F7",
    """select doc_id, n_chars / 40000.0 as confidence from documents where text ilike '%ment%'
order by confidence desc, doc_id limit 50""",
)
def citation_search(t: Tables) -> DataFrame:
    hits = t.documents.withColumn("confidence", F.col("n_chars") / 40000.0)
    return L.search(hits, "ment", ["text"], {}, [F.desc("confidence"), "doc_id"], 50).select("doc_id", "confidence")


@query(
    "route_decision",
    "F12",
    """
with e as (select event_id, event_type, (props->>'k')::int as k from events),
a as (select *, case event_type when 'view' then 'generate' when 'click' then 'filter_and_supplement' when 'signup' then 'rewrite'
   when 'purchase' then 'decompose' else 'other' end as action, case k % 3 when 0 then 'graph' when 1 then 'hybrid' else 'vector' end as route from e)
select event_id, case action when 'filter_and_supplement' then 'web_search'
    when 'rewrite' then case when k % 4 < 2 then 'query_rewriter' else 'web_search' end
    when 'decompose' then 'query_decomposer' else 'answer_generator' end as after_grading,
  case route when 'graph' then 'graph_retriever' when 'hybrid' then 'hybrid_retrieve_start' else 'vector_retriever' end as after_analysis
from a""",
)
def route_decision(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    actions = {"view": "generate", "click": "filter_and_supplement", "signup": "rewrite", "purchase": "decompose"}
    action = F.lit("other")
    for ev, a in actions.items():
        action = F.when(F.col("event_type") == ev, a).otherwise(action)
    route = F.element_at(F.array(F.lit("graph"), F.lit("hybrid"), F.lit("vector")), k % 3 + 1)
    return t.events.select(
        "event_id",
        L.route_after_grading(action, k % 4).alias("after_grading"),
        L.route_after_analysis(route).alias("after_analysis"),
    )


@query(
    "annotations",
    "F13",
    """select event_id, user_id, event_type, ts from events where event_type = 'click' order by ts, event_id""",
)
def annotations(t: Tables) -> DataFrame:
    return (
        t.events.where(F.col("event_type") == "click")
        .orderBy("ts", "event_id")
        .select("event_id", "user_id", "event_type", "ts")
    )
