"""Registered provenance and version queries: E13-E15, A34, A37."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import comparing as CO
from leafmill.operators import graph as G
from leafmill.operators import provenance as V
from leafmill.operators.ranking import version_history
from leafmill.plans.retrieving import BM25, bm25_documents, passages
from leafmill.plans.sqlparts import tokens_sql
from leafmill.registry import query
from leafmill.sources.tables import Tables


@query(
    "find_text_span",
    "E13",
    rf"""with {BM25}, c as (select b.query_id, b.doc_id, b.score, d.text as page, regexp_replace(q.text, '^\s+|\s+$', '', 'g') as needle from bm b join documents d using (doc_id) join benchmark q on q.item_id = b.query_id where rank <= 10),
n as (select *, trim(regexp_replace(needle, '\s+', ' ', 'g')) as norm from c),
s0 as (select *, strpos(page, needle) as e, nullif(regexp_extract(page, replace(regexp_replace(norm, '([^\p{{L}}\p{{N}}\s])', '\\\1', 'g'), ' ', '\s+')), '') as found from n),
s as (select *, coalesce(strpos(page, found), 0) as l from s0)
select query_id, doc_id, (case when e > 0 then e when l > 0 then l end - 1)::int as "start",
 (case when e > 0 then e - 1 + length(needle) when l > 0 then l - 1 + length(found) end)::int as "end",
 case when e > 0 then 1 when l > 0 then 3 else 0 end::int as stage, case when score >= 120 then 'green' when score >= 90 then 'yellow' else 'red' end as color from s""",
)
def find_text_span(t: Tables) -> DataFrame:
    hits = bm25_documents(t, 10)
    q = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("chunk"))
    j = hits.join(t.documents.select("doc_id", F.col("text").alias("page")), "doc_id").join(q, "query_id")
    span = V.find_text_span(F.col("page"), F.col("chunk"))
    confidence = F.when(F.col("score") >= 120, 0.9).when(F.col("score") >= 90, 0.7).otherwise(0.1)
    s = j.select("query_id", "doc_id", span.alias("s"), V.highlight_color(confidence).alias("color"))
    return s.select("query_id", "doc_id", "s.start", F.when(F.col("s.start").isNotNull(), F.col("s.end")).alias("end"), "s.stage", "color")


def _versions(t: Tables) -> DataFrame:
    v = version_history(t.documents.select("source", "doc_id", "text"), "source", "doc_id", "text", F.floor(F.col("doc_id") / 1000))
    return v.where("previous_text is not null").select("source", "doc_id", "previous_text", "text")


@query(
    "text_diff",
    "E14",
    r"""with v as (select doc_id, text, lag(text) over (partition by source order by doc_id) as p from documents),
s as (select doc_id, list_distinct(list_filter(list_transform(string_split(p, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) as a,
   list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) as b from v where p is not null)
select doc_id, len(list_filter(b, lambda x: not list_contains(a, x)))::int as n_added, len(list_filter(a, lambda x: not list_contains(b, x)))::int as n_removed,
  len(list_filter(a, lambda x: list_contains(b, x)))::int as n_kept from s""",
)
def text_diff(t: Tables) -> DataFrame:
    parts = V.line_sets(F.col("previous_text"), F.col("text"))
    return _versions(t).select("doc_id", *[F.size(c).alias(f"n_{n}") for n, c in parts.items()])


# Ordered line differences have no SQL form; tests compare them with the library directly.
@query("text_diff_opcodes", "E14")
def text_diff_opcodes(t: Tables) -> DataFrame:
    d = _versions(t).select("doc_id", V.line_opcodes("previous_text", "text").alias("d")).select("doc_id", "d.*")
    return d.withColumn(
        "summary", V.change_summary(F.col("n_added"), F.col("n_removed"), F.col("n_modified"), F.col("similarity"))
    ).withColumn("similarity", F.round("similarity", 6))


@query(
    "version_id",
    "E15",
    "select doc_id, substr(sha256(text), 1, 16) || '_' || (1704067200000 + doc_id * 1000) as version_id from documents",
)
def version_id(t: Tables) -> DataFrame:
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))
    return t.documents.select("doc_id", V.version_id(F.col("text"), ts).alias("version_id"))


@query(
    "query_history",
    "A34",
    """with c as (select l_orderkey, count(*) as n, string_agg(distinct l_suppkey::varchar, ',' order by l_suppkey::varchar) as sources from lineitem group by 1)
select o_orderkey, o_orderdate, coalesce(n, 0) as n_citations, coalesce(sources, '') as sources from orders left join c on l_orderkey = o_orderkey order by o_orderdate desc, o_orderkey limit 100 offset 50""",
)
def query_history(t: Tables) -> DataFrame:
    page = t.orders.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(50).limit(100)
    cites = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").cast("string").alias("s"))
    # only the page's citations are gathered
    c = cites.join(page.select("o_orderkey"), "o_orderkey", "left_semi").groupBy("o_orderkey").agg(
        F.count("*").alias("n_citations"), F.array_join(F.array_sort(F.collect_set("s")), ",").alias("sources")
    )
    return page.join(c, "o_orderkey", "left").na.fill({"n_citations": 0, "sources": ""})


@query(
    "compare_docs",
    "A37",
    r"""with l as (select source, doc_id, trim(line) as line from (select source, doc_id, unnest(string_split(text, chr(10))) as line from documents)),
d as (select source, line, doc_id, count(*) as n from l where line <> '' group by all)
select source, md5(line) as line_md5, count(*) as n_docs, sum(n)::bigint as n_occurrences from d group by source, line having count(*) >= 2""",
)
def compare_docs(t: Tables) -> DataFrame:
    return G.compare_documents(t.documents, "source", "doc_id", "text").select(
        "source", F.md5("line").alias("line_md5"), "n_docs", "n_occurrences"
    )


#: Jobs of twenty documents in a row.
_JOB_TERMS = f"""jt as (select doc_id // 20 as job, doc_id as doc, unnest({tokens_sql("text")}) as term from documents),
jn as (select doc_id // 20 as job, count(distinct doc_id) as n from documents group by 1 having count(distinct doc_id) between 2 and 50),
tf as (select job, doc, term, count(*) as tf from jt group by all),
wt as (select job, doc, term, tf, df, n, tf * (ln((n + 1) / (df + 1)) + 1) as w from tf join (select job, term, count(*) as df from tf group by all) using (job, term) join jn using (job))"""


def _jobs(t: Tables) -> DataFrame:
    return t.documents.select(F.floor(F.col("doc_id") / 20).alias("job"), F.col("doc_id").alias("doc"), "text")


@query(
    "compare_similarity",
    "A37",
    f"""with {_JOB_TERMS}, u as (select job, doc, term, w / sqrt(sum(w * w) over (partition by job, doc)) as u from wt)
select a.job, a.doc as doc_a, b.doc as doc_b, count(*) as n_shared, round(100 * sum(a.u * b.u), 2) as score from u a join u b on a.job = b.job and a.term = b.term and a.doc < b.doc group by all""",
)
def compare_similarity(t: Tables) -> DataFrame:
    return CO.similarity(_jobs(t), "job", "doc", "text")


@query(
    "compare_difference",
    "A37",
    f"""with {_JOB_TERMS}, r as (select *, row_number() over (partition by job, doc order by case when df = 1 then round(w, 6) end desc nulls last, term) as rn from wt)
select job, doc, count(*) filter (df = 1) as n_own, round(sum(case when df = 1 then w else 0 end) / sum(w), 4) as share,
  coalesce(string_agg(term, ' ' order by rn) filter (df = 1 and rn <= 5), '') as terms from r group by job, doc""",
)
def compare_difference(t: Tables) -> DataFrame:
    return CO.difference(_jobs(t), "job", "doc", "text")


# An iteration over sentences has no SQL here; tests compare it with matrices.
@query("compare_summary", "A37")
def compare_summary(t: Tables) -> DataFrame:
    return CO.summary(_jobs(t), "job", "doc", "text")
