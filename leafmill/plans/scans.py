"""Registered scans and the row side of sinks: S1-S9."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import chunking
from leafmill.plans.sqlparts import BLOCKS
from leafmill.registry import query
from leafmill.sources import sinks
from leafmill.sources.tables import Tables

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@query(
    "table_scan",
    "S1",
    " union all ".join(f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in TABLE_NAMES),
)
def table_scan(t: Tables) -> DataFrame:
    out = None
    for name, df in t.all.items():
        part = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


# head bytes and names come from the document: the language picks the signature, the id the suffix
_HEADS = {"en": "255044462D312E37", "fr": "504B030414000600", "de": "89504E470D0A1A0A00", "es": "68656C6C6F"}
_SUFFIXES = (".pdf", ".xlsx", ".docx", ".mp4", ".txt", ".bin")


@query(
    "file_format",
    "S2",
    f"""
with f as (
  select doc_id,
    case lang {' '.join(f"when '{k}' then '{v}'" for k, v in _HEADS.items())} else '' end || upper(hex(encode(substr(text, 1, 4)))) as head,
    'scan_' || doc_id || (case doc_id % 6 {' '.join(f"when {i} then '{s}'" for i, s in enumerate(_SUFFIXES))} end) as name
  from documents),
g as (select *, regexp_extract(name, '(\\.[^.]*)$', 1) as suffix from f)
select doc_id, name,
  case when head like '25504446%' then 'pdf'
       when head like '504B0304%' then case when suffix = '.xlsx' then 'xlsx' else 'docx' end
       when head like '89504E470D0A1A0A%' then 'png'
       when suffix = '.bin' then 'unknown' else substr(suffix, 2) end as format,
  case when head like '25504446%' or head like '504B0304%' or head like '89504E470D0A1A0A%' then 1.0
       when suffix = '.mp4' then 0.9 when suffix = '.bin' then 0.0 else 0.8 end::double as confidence
from g""",
)
def file_format(t: Tables) -> DataFrame:
    head = F.lit("")
    for lang, h in _HEADS.items():
        head = F.when(F.col("lang") == lang, h).otherwise(head)
    suffix = F.element_at(F.array(*[F.lit(s) for s in _SUFFIXES]), (F.col("doc_id") % 6 + 1).cast("int"))
    files = t.documents.select(
        "doc_id",
        F.concat(F.lit("scan_"), F.col("doc_id"), suffix).alias("name"),
        F.concat(head, F.hex(F.encode(F.substring("text", 1, 4), "UTF-8"))).alias("head"),
    )
    return files.select("doc_id", "name", X.file_format(F.col("head"), F.col("name")).alias("f")).select(
        "doc_id", "name", "f.format", "f.confidence"
    )


@query(
    "html_to_text",
    "S3",
    r"""
with a as (
  select page_id, url,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'),
      '<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as text,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)', 1), '^/+|/+$', '', 'g') as place
  from pages)
select page_id, text, case when place = '' then 'webpage'
  else regexp_replace(place, '[^\p{L}\p{N}\p{M}_.-]', '_', 'g') end || '.txt' as file_name
from a""",
)
def html_to_text(t: Tables) -> DataFrame:
    return t.pages.select(
        "page_id", X.html_to_text(F.col("html")).alias("text"), X.page_file_name(F.col("url")).alias("file_name")
    )


@query("text_blocks", "S4", f"with {BLOCKS} select doc_id, source, block_index, page, text from blocks")
def text_blocks(t: Tables) -> DataFrame:
    return chunking.text_blocks(t.documents).select("doc_id", "source", "block_index", "page", "text")


@query(
    "pipe_table_scan",
    "S5",
    r"""
with l as (
  select doc_id, list_filter(list_transform(string_split(text, chr(10)),
      lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as lines from documents),
r as (
  select doc_id, lines, list_filter(list_transform(list_filter(lines, lambda x: contains(x, '|')),
      lambda x: list_filter(list_transform(string_split(x, '|'), lambda c: regexp_replace(c, '^\s+|\s+$', '', 'g')), lambda c: c <> '')),
      lambda y: len(y) > 0) as rows from l),
e as (select doc_id, rows, unnest(range(len(rows))) as i from r where len(lines) >= 2 and len(rows) >= 2)
select doc_id, i::int as row_index, greatest(len(rows[i + 1]), len(rows[1]))::int as n_cells,
  array_to_string(rows[i + 1], '¦') ||
    repeat('¦', greatest(len(rows[1]) - len(rows[i + 1]), 0)::bigint) as cells
from e""",
)
def pipe_table_scan(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(X.pipe_rows(F.col("text"))).alias("row_index", "r")).select(
        "doc_id", "row_index", F.size("r").alias("n_cells"), F.array_join("r", "¦").alias("cells")
    )


@query(
    "dataset_registry",
    "S7",
    """
with d as (select lang as domain, case when l.quality = 1 then 'v2' else 'v1' end as version, d.doc_id, n_chars
           from documents d left join labels l using (doc_id)),
r as (select domain, version, count(*) as n_samples, sum(n_chars)::bigint as n_chars, max(doc_id) as last_id
      from d group by all)
select domain, version, n_samples, n_chars, last_id,
  row_number() over (order by last_id desc, domain, version)::int as newest_rank from r""",
)
def dataset_registry(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left").select(
        F.col("lang").alias("domain"),
        F.when(F.col("quality") == 1, "v2").otherwise("v1").alias("version"),
        "doc_id",
        "n_chars",
    )
    return sinks.dataset_registry(rows, "doc_id", "n_chars")


@query(
    "dead_letter",
    "S8",
    """
with c as (
  select d.doc_id, d.source, case when l.doc_id is null then 'no_label' end as a,
    case when l.toxic = 1 then 'toxic' end as b, case when d.n_chars < 200 then 'too_short' end as c
  from documents d left join labels l using (doc_id))
select doc_id, source, concat_ws('|', a, b, c) as reasons from c where concat_ws('|', a, b, c) <> ''""",
)
def dead_letter(t: Tables) -> DataFrame:
    df = t.documents.join(t.labels.withColumn("labelled", F.lit(True)), "doc_id", "left")
    checks = {
        "no_label": F.col("labelled").isNull(),
        "toxic": F.col("toxic") == 1,
        "too_short": F.col("n_chars") < 200,
    }
    _, bad = sinks.dead_letter(df, checks)
    return bad.select("doc_id", "source", F.array_join("reasons", "|").alias("reasons"))


@query(
    "prometheus_gauges",
    "S9",
    """
with s as (
  select count(*) as n, avg(value) as m, max(value) as x from events),
a as (select event_type, count(*) as n from events group by 1)
select 'engine_query_count_total' as metric, 'counter' as type, round(n::double, 4) as value from s
union all select 'engine_query_value_mean', 'gauge', round(m, 4) from s
union all select 'engine_query_value_max', 'gauge', round(x, 4) from s
union all select 'engine_action_' || regexp_replace(event_type, '[- "]', '_', 'g'), 'counter', round(n::double, 4) from a""",
)
def prometheus_gauges(t: Tables) -> DataFrame:
    stats = t.events.agg(
        F.count("*").cast("double").alias("query_count_total"),
        F.avg("value").alias("query_value_mean"),
        F.max("value").alias("query_value_max"),
    )
    return sinks.prometheus_gauges(
        stats, t.events.groupBy(F.col("event_type").alias("action")).count(), prefix="engine"
    ).withColumn("value", F.round("value", 4))


@query(
    "csv_report",
    "S6",
    """select event_id::varchar as event_id, coalesce(c_name, '') as c_name, event_type, case when event_type = 'error' then '' else user_id::varchar end as user_id
from events left join customer on c_custkey = user_id""",
)
def csv_report(t: Tables) -> DataFrame:
    audit = t.events.join(t.customer, F.col("user_id") == F.col("c_custkey"), "left").withColumn(
        "user_id", F.when(F.col("event_type") != "error", F.col("user_id"))
    )
    return sinks.report_columns(audit, ["event_id", "c_name", "event_type", "user_id"])
