"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import chat, collocations, exact, licenses, lines, mixing, packing, quality, ranked, sharding, simhash, urls, warc
from leafmill.llm.registry import query
from leafmill.llm.shared import checkpointed, shared_folder, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query(
    "op9_exact_dedup",
    r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
           from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = min(doc_id) over g as kept,
       text_sha256
from d window g as (partition by text_sha256)""",
)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches in id order, so that the second meets a filled index; each digest's smallest id stays."""
    every = checkpointed(exact.digests(table(spark, sf_dir, "documents")))
    middle = every.agg(F.expr("percentile_approx(doc_id, 0.5)")).first()[0] or 0
    later = F.coalesce(F.col("doc_id") > middle, F.lit(True))
    index = exact.DigestIndex(
        spark, f"op9_digests_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    rows = exact.deduplicated([every.where(~later), every.where(later)], index)
    out = checkpointed(rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")))
    index.drop()
    return out


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


#: Measures of each document, with words and lines as lists; shared by the quality oracle.
_MEASURED_SQL = r"""
texts as (select doc_id, lang, source, coalesce(text, '') as t from documents),
parts as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines from texts),
windows as (select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as w
  from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from parts)),
twice as (select *, count(*) over (partition by doc_id, w) as n from windows),
repeated as (select doc_id, count(distinct i + k) as n from twice, (select unnest([0, 1, 2]) as k) where n > 1 group by 1),
counted as (select doc_id, lang, source, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(lines) as n_lines,
  len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words
  from parts left join repeated using (doc_id)),
measured as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  coalesce(n_symbols * 10000 // nullif(n_words, 0), 0) as m_symbols,
  coalesce(n_dup_lines * 10000 // nullif(n_lines, 0), 0) as m_dup_lines,
  coalesce(n_repeat_words * 10000 // nullif(n_words, 0), 0) as m_repeats,
  coalesce(word_chars * 100 // nullif(n_words, 0), 0) as m_length from counted)"""


def _quartiles_sql(keys: str) -> str:
    by = f"{keys}, measure" if keys else "measure"
    return f"""(select {by}, min(bin) filter (upto * 4 >= total) as q1, min(bin) filter (upto * 4 >= total * 3) as q3,
      max(total) as total from (select {by}, bin, sum(n) over (partition by {by} order by bin) as upto,
      sum(n) over (partition by {by}) as total
      from (select {by}, bin, sum(n) as n from bins group by all)) group by all)"""


def _quality_sql(fence: int = 5, min_docs: int = 200) -> str:
    floors = " ".join(f"when '{m}' then {v}" for m, v in quality.MEASURES.items())
    edge = "(((b - e * 32 + 1)::bigint << e) - 1)"
    edges = {q: edge.replace("e *", f"e{q} *").replace("<< e", f"<< e{q}").replace("(b", f"(b{q}") for q in ("1", "3")}
    return f"""with {_MEASURED_SQL},
    bins as (select lang, source, measure, greatest(length(bin(v)) - 6, 0) * 32
      + (v >> greatest(length(bin(v)) - 6, 0)) as bin, count(*) as n
      from (select lang, source, measure, v::bigint as v from measured
        unpivot (v for measure in ({', '.join(quality.MEASURES)})) where not base_failed) group by all),
    chosen as (select o.lang, o.source, o.measure,
      case when o.total >= {min_docs} then o.q1 when l.total >= {min_docs} then l.q1 else a.q1 end as b1,
      case when o.total >= {min_docs} then o.q3 when l.total >= {min_docs} then l.q3 else a.q3 end as b3
      from {_quartiles_sql('lang, source')} o
      join {_quartiles_sql('lang')} l on o.lang is not distinct from l.lang and o.measure = l.measure
      join {_quartiles_sql('')} a on o.measure = a.measure),
    edges as (select *, greatest(b1 // 32 - 1, 0)::bigint as e1, greatest(b3 // 32 - 1, 0)::bigint as e3 from chosen),
    limits as (select lang, source, measure,
      greatest({edges['3']} + greatest({fence} * ({edges['3']} - {edges['1']}), {edges['3']} // 4),
        case measure {floors} end) as upper,
      {edges['1']} - greatest({fence} * ({edges['3']} - {edges['1']}), {edges['1']} // 4) as low from edges),
    odd as (select distinct m.doc_id from measured m
      join limits t on m.lang is not distinct from t.lang and m.source is not distinct from t.source
      where case t.measure {' '.join(f"when '{m}' then m.{m}" for m in quality.MEASURES)} end > t.upper
        or (t.measure = '{quality.TWO_SIDED}' and m.{quality.TWO_SIDED} < t.low))
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      not base_failed and doc_id not in (select doc_id from odd) as kept from measured"""


@query("op5_quality", _quality_sql())
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


@query("op6_lines")
def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.every_line_groups(table(spark, sf_dir, "documents"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """Labelled good documents are drawn twice as readily as unlabelled ones, labelled bad ones half as readily."""
    weight = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)
    return labels.select(F.col("doc_id").alias("id"), weight.alias("weight"))


@query(
    "op3_mixing",
    r"""
with w as (select doc_id, max(case quality when 1 then 2.0 when 0 then 0.5 else 1.0 end)::double as weight
           from labels group by 1),
d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
        -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint + 0.5::double)
            / 4503599627370496.0::double) / coalesce(weight, 1.0::double) as key
      from documents left join w using (doc_id)),
s as (select source, sum(size)::bigint as z, row_number() over (order by source nulls last) - 1 as place from d group by 1),
ranked as (select *, [5, 2, 1][place % 3 + 1] as w, sum(z) over () as zz, sum([5, 2, 1][place % 3 + 1]) over () as ww from s),
run as (select *, coalesce(sum(z) over b, 0) as z0, coalesce(sum(w) over b, 0) as w0 from ranked
        window b as (order by z / w, place rows between unbounded preceding and 1 preceding)),
capped as (select *, (3 * zz - 4 * z0)::hugeint * w >= 4 * z::hugeint * (ww - w0) as full_ from run),
rest as (select *, sum(case when full_ then z else 0 end) over () as zc,
         sum(case when full_ then 0 else w end) over () as wu from capped),
t as (select source, z, case when full_ then 2 * z::double
        else w * (1.5::double * zz::double - 2.0::double * zc::double) / wu::double end as target from rest),
e as (select *, case when z > 0 then least(floor(target / z), 2) else 0 end as epochs from t),
p as (select d.*, z, target, epochs, target - epochs * z as rest,
        2 * sum(size) over (partition by d.source order by key, doc_id) - sum(size) over (partition by d.source, key, doc_id)
        as twice from d join e on d.source is not distinct from e.source)
select doc_id, size, z as source_size, target,
  (size * (epochs + case when epochs < 2 and twice <= 2 * rest then 1 else 0 end))::bigint as taken from p""",
)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), quality_weights(table(spark, sf_dir, "labels")))


@query("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return plan.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _license_pattern(markup: str) -> str:
    """A regular expression over words, each with a blank behind it, by rewriting the markup as text."""
    out = ["(?:^| )"]
    for opens, closes, most, word in re.findall(
        r"(<<beginOptional>>)|(<<endOptional>>)|<<var[^>]*match=(\d+)[^>]*>>|([0-9A-Za-z]+)", markup
    ):
        out.append("(?:" if opens else ")?" if closes else f"(?:[^ ]+ ){{0,{most}}}" if most else f"{word.lower()} ")
    return "".join(out)


def _licenses_sql() -> str:
    """Phrases by list positions, templates as regular expressions over the words."""
    places = []
    for phrase, label in licenses.PHRASES.items():
        same = " and ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(phrase.split()))
        places.append(f"select doc_id, '{label}' as label, i - 1 as pos from spot where {same}")
    found = " union ".join(
        f"select doc_id, '{label}' as label, {score} as score from texts where regexp_matches(line, '{_license_pattern(t)}')"
        for score, templates in ((1.0, licenses.TEMPLATES), (0.75, licenses.NOTICES))
        for label, t in templates.items()
    )
    return f"""
with cut as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
       'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents),
texts as (select *, array_to_string(words, ' ') || ' ' as line from cut),
spot as (select doc_id, words, unnest(range(1, len(words) + 1)) as i from texts where line like '%license%'),
base as ({' union all '.join(places)}),
b as (select doc_id, count(*) as n_base, min(pos) as first_word, max(pos) as last_word,
        string_agg(distinct label, ',' order by label) as base_labels from base group by 1),
own as ({found}),
l as (select doc_id, string_agg(distinct label, ',' order by label) as labels
      from (select doc_id, label from own union select doc_id, label from base) group by 1)
select doc_id, len(words) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  coalesce(best, case when n_base > 0 then 0.5 else 0.0 end)::double as score
from texts left join b using (doc_id) left join l using (doc_id)
left join (select doc_id, max(score) as best from own group by 1) using (doc_id)"""


@query("op4_licenses", _licenses_sql())
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


@query(
    "op2_chat",
    r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
           union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
-- An opening of a control string gets one character more.
e as (select *, case when role = 'assistant' then text else '' end as learned,
        len(regexp_extract_all(text, '(?:<|\[)\\*(?:\||/?s>|/?SYS>>|/?INST\])'))
        + len(regexp_extract_all(role, '(?:<|\[)\\*(?:\||/?s>|/?SYS>>|/?INST\])')) as escapes from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(length(learned))::bigint as loss_chars, sha256(string_agg(learned, '' order by turn, role, text)) as loss_sha256,
  sum(length(role) + length(text) + escapes + 8 + 8 + 7)::bigint as formatted_chars
from e group by conv_id""",
)
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).selectExpr(
        "-1L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", "'</s>[INST] ok [/INST]' as text"
    )
    formatted = chat.format_conversations(chat.with_parts(turns.unionByName(probe)))
    return chat.read_back(formatted, in_order=True)


@query("op8_urls")
def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query(
    "op11_ranked_search",
    r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
       'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
q as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
       'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
s as (select count(*) as nn, sum(len(words))::bigint as ll from d where len(words) > 0),
p as (select doc_id, n, term, count(*) as tf from (select doc_id, len(words)::bigint as n, unnest(words) as term from d)
      group by all),
w as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double))::bigint as w
      from (select term, count(*) as df from p group by 1), s),
scored as (select item_id, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::bigint as score
  from q join w using (term) join p using (term), s group by all),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scored where score > 0)
select item_id, rank, doc_id, score from r where rank <= 50""",
)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 50)


@query(
    "op13_warc",
    """
with p as (select page_id, coalesce(html, '') as html from pages),
g as (select *, max(page_id) over (partition by html) as top, octet_length(encode(html)) >= 1000 as large from p)
select page_id, octet_length(encode(html))::bigint as payload_bytes, sha1(html) as payload_digest,
  case when large and page_id <> top then 'revisit' else 'response' end as record_type,
  case when large and page_id <> top then top end as refers_to from g""",
)
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.resolved(warc.read_archives(spark, folder))


@query(
    "op12_collocations",
    r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) as piece from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') as ws from p),
spot as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w),
g as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase, count(*) as f
      from spot, (select unnest([1, 2, 3]) as k) where i + k - 1 <= len(ws) group by all),
n as (select lang, sum(f)::bigint as n from g where k = 1 group by 1),
c as (select *, string_split(phrase, ' ') as ws from g where k > 1 and f >= 10),
cut as (select c.lang, c.phrase, c.f as a, j, l.f as l, r.f as r, (1000000::hugeint * c.f * c.f) // (l.f::hugeint * r.f) as score
  from (select *, unnest(range(1, k)) as j from c) c
  join g l on l.lang = c.lang and l.phrase = array_to_string(c.ws[1:j], ' ')
  join g r on r.lang = c.lang and r.phrase = array_to_string(c.ws[j + 1:], ' ')),
low as (select * from cut qualify row_number() over (partition by lang, phrase order by score, j) = 1),
covered as (select lang, phrase, max(f) as longer from (select lang, f, unnest([array_to_string(ws[1:2], ' '),
  array_to_string(ws[2:3], ' ')]) as phrase from c where k = 3) group by all),
ranked as (select low.*, row_number() over (partition by low.lang order by score desc, a desc, low.phrase) as rank
  from low left join covered using (lang, phrase) where longer is null or 100 * longer < 50 * a)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join n using (lang) where rank <= 2000""",
)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
