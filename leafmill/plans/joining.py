"""Registered joins, set operations and table maintenance: J1-J7, J11, J12, U2-U4, M1, M3-M5."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import chunking as C
from leafmill.operators import joins as J
from leafmill.operators import maintenance as M
from leafmill.plans.sqlparts import BLOCKS
from leafmill.registry import query
from leafmill.sources.tables import Tables

NTZ = "timestamp_ntz'{}'".format


def between(col: str, lo: str, hi: str):
    return (F.col(col) >= F.expr(NTZ(lo))) & (F.col(col) < F.expr(NTZ(hi)))


@query(
    "tenant_left_join",
    "J1",
    """select c_custkey, count(o_orderkey) as n_orders, coalesce(round(sum(o_totalprice), 2), 0.0) as total
from customer left join orders on o_custkey = c_custkey and o_orderdate >= timestamp '1998-01-01' and o_orderdate < timestamp '1998-02-01'
group by c_custkey""",
)
def tenant_left_join(t: Tables) -> DataFrame:
    used = (
        t.orders.where(between("o_orderdate", "1998-01-01", "1998-02-01"))
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )
    return t.customer.select("c_custkey").join(used, "c_custkey", "left").na.fill(0)


@query(
    "members_earliest",
    "J2",
    """with j as (select n_name, o_orderdate, o_orderkey, c_custkey from orders join customer on o_custkey = c_custkey
   join nation on c_nationkey = n_nationkey)
select n_name, o_orderkey, c_custkey, o_orderdate from (select *, row_number() over (partition by n_name order by o_orderdate, o_orderkey) as rn from j) where rn = 1""",
)
def members_earliest(t: Tables) -> DataFrame:
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    first = F.min(F.struct("o_orderdate", "o_orderkey", "c_custkey")).alias("f")
    return j.groupBy("n_name").agg(first).select("n_name", "f.o_orderkey", "f.c_custkey", "f.o_orderdate")


@query(
    "answers_citing",
    "J3",
    """select o_orderkey, o_orderdate from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey
  and l_returnflag = 'R' and l_quantity > 45) order by o_orderdate desc, o_orderkey limit 200""",
)
def answers_citing(t: Tables) -> DataFrame:
    cited = t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45))
    return (
        t.orders.join(cited, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
        .orderBy(F.desc("o_orderdate"), "o_orderkey")
        .limit(200)
        .select("o_orderkey", "o_orderdate")
    )


@query(
    "acl_filter",
    "J4",
    """with d as (select doc_id, case when doc_id % 50 = 7 then 'web:' || source else source end as source from documents)
select d.doc_id, d.source from d where source like 'web:%' or not exists (select 1 from labels l where l.doc_id = d.doc_id)
  or exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1)""",
)
def acl_filter(t: Tables) -> DataFrame:
    docs = t.documents.select(
        "doc_id", F.when(F.col("doc_id") % 50 == 7, F.concat(F.lit("web:"), "source")).otherwise(F.col("source")).alias("source")
    )
    grants = t.labels.select("doc_id", F.concat(F.lit("u"), "quality").alias("grantee"))
    return J.acl_visible(docs, grants, F.lit("u1"))


@query(
    "orphans",
    "J5",
    "select doc_id from labels where doc_id not in (select doc_id from documents where lang <> 'en')",
)
def orphans(t: Tables) -> DataFrame:
    return t.labels.select("doc_id").join(t.documents.where("lang <> 'en'").select("doc_id"), "doc_id", "left_anti")


@query(
    "expand_to_parents",
    "J6",
    f"""with {BLOCKS},
h as (select lang as query_id, doc_id * 100000 + block_index as rank, doc_id || '-' || block_index as chunk_id,
   case when doc_id % 5 = 0 then 'gone-' else '' end || doc_id as parent_id, text from blocks where contains(text, 'ti')),
j as (select h.*, d.text as parent_text, case when d.text is not null then 'p:' || parent_id else 'c:' || chunk_id end as unit
   from h left join documents d on d.doc_id::varchar = h.parent_id),
r as (select *, row_number() over (partition by query_id, unit order by rank) as rn from j)
select query_id, unit, rank, chunk_id, md5(coalesce(parent_text, text)) as text_md5, parent_text is not null as expanded
from r where rn = 1""",
)
def expand_to_parents(t: Tables) -> DataFrame:
    hits = C.text_blocks(t.documents).where(F.contains("text", F.lit("ti"))).select(
        F.col("lang").alias("query_id"),
        (F.col("doc_id") * 100000 + F.col("block_index")).alias("rank"),
        F.concat_ws("-", "doc_id", "block_index").alias("chunk_id"),
        F.concat(F.when(F.col("doc_id") % 5 == 0, "gone-").otherwise(""), "doc_id").alias("parent_id"),
        "text",
    )
    parents = t.documents.select(F.col("doc_id").cast("string").alias("parent_id"), "text")
    return J.expand_to_parents(hits, parents).select(
        "query_id", "unit", "rank", "chunk_id", F.md5("text").alias("text_md5"), "expanded"
    )


@query(
    "speaker_at",
    "J7",
    """
with s as (select conv_id, turn, turn * 7.0 + 2.5 as mid from conversations),
i as (select conv_id, turn * 10.0 as a, turn * 10.0 + 8.0 as b, case role when 'user' then 'Speaker A' when 'assistant' then 'Speaker B' else 'Speaker C' end as label from conversations),
j as (select s.conv_id, s.turn, s.mid, i.label, row_number() over (partition by s.conv_id, s.turn order by i.a nulls last, i.b, i.label) as rn
  from s left join i on i.conv_id = s.conv_id and mid between a and b)
select conv_id, turn, mid::double as mid, label from j where rn = 1""",
)
def speaker_at(t: Tables) -> DataFrame:
    turn = F.col("turn").cast("double")
    seg = t.conversations.select("conv_id", "turn", (turn * 7.0 + 2.5).alias("mid"))
    speaker = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    turns = t.conversations.select(
        "conv_id",
        (turn * 10.0).alias("start"),
        (turn * 10.0 + 8.0).alias("end"),
        F.concat(F.lit("Speaker "), F.char(speaker + 65)).alias("label"),
    )
    return J.points_in_intervals(seg, turns, "conv_id", "mid", "start", "end", 30.0)


@query(
    "drift_reference_join",
    "J11",
    """with m as (select max(ts) as now from events)
select case when ts > now - interval 7 days then 'current' else 'reference' end as part, event_type, count(*) as n,
  round(avg(value), 6) as mean_value from events, m where ts > now - interval 14 days group by all""",
)
def drift_reference_join(t: Tables) -> DataFrame:
    now = t.events.select(F.max("ts")).scalar()
    age = now - F.col("ts")
    part = F.when(age < F.expr("interval 7 days"), "current").when(age < F.expr("interval 14 days"), "reference")
    return (
        t.events.withColumn("part", part)
        .where(F.col("part").isNotNull())
        .groupBy("part", "event_type")
        .agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    )


@query(
    "hook_fanout",
    "J12",
    """with h as (select n_nationkey as hook_id, unnest(case n_nationkey % 3 when 0 then ['view', 'error'] when 1 then ['purchase'] else ['signup', 'error', 'click'] end) as event_type
  from nation where n_regionkey <> 0)
select h.hook_id, event_type, count(*) as n_deliveries, max(ts) as last_ts from events join h using (event_type) group by all""",
)
def hook_fanout(t: Tables) -> DataFrame:
    lists = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("view"), F.lit("error"))).when(
        F.col("n_nationkey") % 3 == 1, F.array(F.lit("purchase"))
    ).otherwise(F.array(F.lit("signup"), F.lit("error"), F.lit("click")))
    hooks = t.nation.select(
        F.col("n_nationkey").alias("hook_id"), lists.alias("events"), (F.col("n_regionkey") != 0).alias("active")
    )
    return (
        J.hook_fanout(t.events, hooks)
        .groupBy("hook_id", "event_type")
        .agg(F.count("*").alias("n_deliveries"), F.max("ts").alias("last_ts"))
    )


@query(
    "new_chunks",
    "U2",
    f"""with {BLOCKS},
k as (select doc_id, block_index, md5(text) as chunk_id from blocks)
select chunk_id from k group by 1 except select md5(b.text) from blocks b join labels l using (doc_id) where quality = 1""",
)
def new_chunks(t: Tables) -> DataFrame:
    chunks = C.text_blocks(t.documents).select("doc_id", F.md5("text").alias("chunk_id"))
    existing = chunks.join(t.labels.where("quality = 1"), "doc_id", "left_semi").select("chunk_id").distinct()
    return M.new_rows(chunks.select("chunk_id"), existing, "chunk_id")


@query(
    "token_overlap",
    "U3",
    """with w as (select p_partkey, list_distinct(string_split(lower(p_name), ' ')) as a, list_distinct(string_split(lower(p_type || ' ' || p_name), ' ')) as b from part)
select p_partkey, len(list_intersect(a, b))::int as shared, len(list_intersect(a, b)) / greatest(len(a), len(b), 1)::double as overlap from w""",
)
def token_overlap(t: Tables) -> DataFrame:
    a = F.array_distinct(F.split(F.lower("p_name"), " "))
    b = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_type", "p_name")), " "))
    shared = F.size(F.array_intersect(a, b))
    return t.part.select(
        "p_partkey", shared.alias("shared"), (shared / F.greatest(F.size(a), F.size(b), F.lit(1))).alias("overlap")
    )


@query(
    "unsupported_values",
    "U4",
    """select source, coalesce(string_agg(lang, ',' order by lang), '') as unsupported from
 (select distinct source, case when lang in ('en', 'fr') then null else lang end as lang from documents) group by source""",
)
def unsupported_values(t: Tables) -> DataFrame:
    supported = F.array(F.lit("en"), F.lit("fr"))
    asked = t.documents.select("source", "lang").distinct().groupBy("source").agg(F.collect_set("lang").alias("asked"))
    return asked.select(
        "source", F.array_join(F.array_sort(F.array_except("asked", supported)), ",").alias("unsupported")
    )


@query(
    "upsert_latest",
    "M1",
    """with b as (select c_custkey, c_mktsegment as status, timestamp '1990-01-01' as updated_at, 0::bigint as v from customer
 union all select o_custkey, o_orderstatus, o_orderdate, o_orderkey from orders)
select c_custkey, status, updated_at from (select *, row_number() over (partition by c_custkey order by updated_at desc, v desc) as rn from b) where rn = 1""",
)
def upsert_latest(t: Tables) -> DataFrame:
    base = t.customer.select(
        "c_custkey", F.col("c_mktsegment").alias("status"), F.expr(NTZ("1990-01-01")).alias("updated_at"), F.lit(0).cast("bigint").alias("v")
    )
    changes = t.orders.select(
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("updated_at"),
        F.col("o_orderkey").alias("v"),
    )
    stamp = F.struct("updated_at", "v").alias("stamp")
    out = M.upsert(base.select("*", stamp), changes.select("*", stamp), "c_custkey", "stamp")
    return out.select("c_custkey", "status", "updated_at")


@query(
    "delete_document",
    "M3",
    f"""with {BLOCKS}, v as (select doc_id from labels where toxic = 1)
select 'documents' as table_name, count(*) as n_removed from documents join v using (doc_id)
union all select 'chunks', count(*) from blocks join v using (doc_id)
union all select 'kept_chunks', count(*) from blocks where doc_id not in (select doc_id from v)""",
)
def delete_document(t: Tables) -> DataFrame:
    tables = {"documents": t.documents.select("doc_id"), "chunks": C.text_blocks(t.documents)}
    kept, removed = M.delete_cascade(tables, t.labels.where("toxic = 1"), "doc_id")
    left = kept["chunks"].agg(F.count("*").alias("n_removed")).select(F.lit("kept_chunks").alias("table_name"), "n_removed")
    return removed.unionByName(left)


@query(
    "apply_plan",
    "M5",
    """
with w as (select c_custkey as workspace_id, 'free' as plan, 'active' as status, 5 as max_docs, 50 as max_queries, 0.1::double as max_storage_gb from customer),
c as (select o_custkey as workspace_id, ['starter', 'pro', 'enterprise', 'gold'][(max(o_orderkey) % 4 + 1)::int] as new_plan,
   case when max(o_orderkey) % 3 = 0 then 'past_due' end as new_status from orders group by 1)
select workspace_id, coalesce(new_plan, plan) as plan, coalesce(new_status, status) as status,
 case new_plan when 'starter' then 100 when 'pro' then 1000 when 'enterprise' then null else max_docs end as max_docs,
 case new_plan when 'starter' then 500 when 'pro' then null when 'enterprise' then null else max_queries end as max_queries,
 case new_plan when 'starter' then 2.0 when 'pro' then 20.0 when 'enterprise' then null else max_storage_gb end::double as max_storage_gb
from w left join c using (workspace_id)""",
)
def apply_plan(t: Tables) -> DataFrame:
    w = t.customer.select(
        F.col("c_custkey").alias("workspace_id"),
        F.lit("free").alias("plan"),
        F.lit("active").alias("status"),
        F.lit(5).alias("max_docs"),
        F.lit(50).alias("max_queries"),
        F.lit(0.1).alias("max_storage_gb"),
    )
    names = F.array(*[F.lit(p) for p in ("starter", "pro", "enterprise", "gold")])
    last = t.orders.groupBy(F.col("o_custkey").alias("workspace_id")).agg(F.max("o_orderkey").alias("k"))
    changes = last.select(
        "workspace_id",
        F.element_at(names, (F.col("k") % 4 + 1).cast("int")).alias("new_plan"),
        F.when(F.col("k") % 3 == 0, "past_due").alias("new_status"),
    )
    return M.apply_plan(w, changes)
