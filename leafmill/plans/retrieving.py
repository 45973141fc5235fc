"""Registered retrieval: R3-R15, R18-R20, J13, U1, M4."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.functions import vectors as V
from leafmill.operators import retrieval as R
from leafmill.operators.maintenance import VectorStore
from leafmill.operators.textindex import TextIndex
from leafmill.operators.vectorindex import VectorIndex
from leafmill.operators.ranking import cached_replay, threshold_top_k, top_k_per_key
from leafmill.plans.sqlparts import BLOCKS, tokens_sql
from leafmill.registry import query
from leafmill.sources.scratch import scratch_folder, stored_at
from leafmill.sources.tables import Tables

TOK = f"t as (select doc_id, {tokens_sql('text')} as toks from documents)"
POST = (
    TOK
    + """, post as (select doc_id, len(toks) as dl, term, count(*) as tf from (select doc_id, toks, unnest(toks) as term from t) group by all),
terms as (select term, count(*) as df from post group by 1),
stat as (select count(*) as n, avg(len(toks)) as avgdl from t where len(toks) > 0)"""
)
BM25 = (
    POST
    + f""", raw as (select term, ln(n - df + 0.5) - ln(df + 0.5) as idf from terms, stat),
idf as (select term, case when idf < 0 then 0.25 * (select avg(idf) from raw) else idf end as idf from raw),
qt as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest({tokens_sql('text')}) as term from benchmark) group by all),
sc as (select query_id, doc_id, round(sum(qtf * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))), 6) as score
  from qt join idf using (term) join post using (term), stat group by 1, 2),
bm as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from sc where score > 0)"""
)


def _embed_cte(name: str, src: str, key: str) -> str:
    """Hashed unit vectors as arrays (every document has all slots only if it has the tokens, so slots are filled)."""
    return f"""{name}_tok as (select {key}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')) as tok from {src}),
{name}_h as (select {key}, sha256(tok) as h from {name}_tok),
{name}_i as (select {key}, (('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::bigint % 64)::int as idx,
   sum(case when ('0x' || substr(h, 9, 2))::int % 2 = 0 then 1 else -1 end) as s from {name}_h group by all),
{name}_n as (select {key}, sqrt(sum(s * s)) as n from {name}_i group by 1),
{name} as (select {key}, list(coalesce(s, 0) / case when n > 0 then n else 1 end order by g.idx) as v
  from (select {key}, n, unnest(range(64)) as idx from {name}_n) g left join {name}_i using ({key}, idx) group by {key})"""


DENSE = (
    _embed_cte("dv", "documents", "doc_id")
    + ", "
    + _embed_cte("qv", "benchmark", "item_id")
    + """,
dsc as (select item_id as query_id, doc_id, round(list_dot_product(dv.v, qv.v), 6) as score from dv, qv),
dn as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from dsc)"""
)


def passages(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def word_tokens(col: str = "text"):
    return F.regexp_extract_all(F.lower(F.col(col)), F.lit(r"(?U)\w+"), F.lit(0))


def search_index(t: Tables) -> TextIndex:
    """The stored index of the documents: built when their files are first seen, read from then on."""
    index = TextIndex(t.spark, f"{scratch_folder(t.spark)}/search-index-1-{files_mark(t, 'documents')}")
    if not index.committed("documents"):
        vectors = V.hash_embed(t.documents, "doc_id", word_tokens()).withColumnRenamed("doc_id", "key")
        index.add("documents", t.documents, vectors=vectors)
    return index


def bm25_documents(t: Tables, k: int | None) -> DataFrame:
    """The best ``k`` documents of each passage, or all that have a score above 0."""
    return search_index(t).search(passages(t), k)


def dense_documents(t: Tables, k: int) -> DataFrame:
    q = V.hash_embed(t.benchmark, "item_id", word_tokens()).withColumnRenamed("item_id", "query_id")
    d = search_index(t).vectors().withColumnRenamed("key", "vec_id")
    return R.dense_topk(q, d, k).withColumnRenamed("vec_id", "doc_id")


@query(
    "bm25_index",
    "R3",
    f"with {POST} select term, df, sum(tf)::bigint as n_occurrences, sum(dl)::bigint as sum_dl from terms join post using (term) group by all",
)
def bm25_index(t: Tables) -> DataFrame:
    """Read from the stored blocks."""
    total = lambda c: F.sum(F.aggregate(F.col(c), F.lit(0), lambda a, x: a + x))
    blocks = search_index(t).postings().groupBy("term")
    return blocks.agg(F.sum("n").alias("df"), total("tfs").alias("n_occurrences"), total("dls").alias("sum_dl"))


@query("bm25_score", "R4", f"with {BM25} select query_id, doc_id, score, rank from bm")
def bm25_score(t: Tables) -> DataFrame:
    """Every score above 0; the best few of them are asked for by the searches that fuse, expand or cite them."""
    return bm25_documents(t, None)


_CENTROIDS = """c as (select label as query_id, list(m order by i) as v from (select label, i, avg(embedding[i]::double) as m
   from (select label, embedding, unnest(range(1, 65)) as i from embeddings) group by all) group by 1),
s as (select query_id, vec_id, label, round(list_cosine_similarity(embedding::double[], v), 6) as score from embeddings, c),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)"""


def centroids(t: Tables) -> DataFrame:
    c = V.mean_vectors(t.embeddings.where("label is not null"), ["label"], "embedding")
    return c.withColumnRenamed("label", "query_id")


@query("dense_topk", "R5", f"with {_CENTROIDS} select query_id, vec_id, score, rank from r where rank <= 10")
def dense_topk(t: Tables) -> DataFrame:
    return R.dense_topk(centroids(t), t.embeddings, 10)


def files_mark(t: Tables, table: str) -> str:
    """A name for the present files of a table: their paths, sizes and times."""
    files = t.spark.read.format("binaryFile").load(f"{t.path}/{table}.parquet").select("path", "length", "modificationTime")
    n, total = files.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return f"{n}-{abs(total)}"


def vector_index(t: Tables) -> VectorIndex:
    """The stored cells of the embeddings: built when their files are first seen, read from then on."""
    path = f"{scratch_folder(t.spark)}/vector-index-1-{files_mark(t, 'embeddings')}"
    if not stored_at(t.spark, f"{path}/centroids/_SUCCESS"):
        VectorIndex.build(t.embeddings, path)
    return VectorIndex(t.spark, path)


@query("dense_topk_cells", "R5", f"with {_CENTROIDS} select query_id, vec_id, score, rank from r where rank <= 10")
def dense_topk_cells(t: Tables) -> DataFrame:
    """The same hits from the partitioned index, in its exact mode."""
    return vector_index(t).search(centroids(t), 10)


@query("query_corpus_scores", "J13", f"with {DENSE} select query_id, doc_id, score, rank from dn where rank <= 10")
def query_corpus_scores(t: Tables) -> DataFrame:
    return dense_documents(t, 10)


_LISTS = """a as (select user_id as query_id, event_id as item, row_number() over (partition by user_id order by value desc, event_id) as rank from events),
b as (select user_id as query_id, event_id as item, row_number() over (partition by user_id order by (props->>'k')::int desc, event_id) as rank from events)"""


def _lists(t: Tables) -> dict[str, DataFrame]:
    ev = t.events.select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("item"), "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    return {
        "a": top_k_per_key(ev, ["query_id"], "value", "item", 20),
        "b": top_k_per_key(ev, ["query_id"], "k", "item", 20),
    }


_RRF = f"""with {_LISTS}, u as (select query_id, item, 'a' as src, rank, (0.6::double / (60 + rank)) as s from a where rank <= 20
  union all select query_id, item, 'b', rank, 0.4::double / (60 + rank) from b where rank <= 20),
f as (select query_id, item, sum(s) as rrf_score, max(rank) filter (src = 'a')::int as rank_a, max(rank) filter (src = 'b')::int as rank_b from u group by 1, 2)"""


@query("rrf", "R6", _RRF + " select query_id, item, round(rrf_score, 9) as rrf_score, rank_a, rank_b from f")
def rrf(t: Tables) -> DataFrame:
    return R.rrf(_lists(t), [3.0, 2.0], "item").withColumn("rrf_score", F.round("rrf_score", 9))


@query(
    "minmax_fusion",
    "R6",
    """with a as (select user_id as query_id, event_id as item, value as score from events),
b as (select user_id as query_id, event_id as item, (props->>'k')::int as score from events where event_id % 3 > 0),
na as (select query_id, item, (score - min(score) over w) / case when max(score) over w = min(score) over w then 1 else max(score) over w - min(score) over w end as s from a window w as (partition by query_id)),
nb as (select query_id, item, (score - min(score) over w) / case when max(score) over w = min(score) over w then 1 else max(score) over w - min(score) over w end as s from b window w as (partition by query_id))
select query_id, item, round(0.75::double * na.s + coalesce(0.25::double * nb.s, 0), 6) as fused_score, round(na.s, 6) as unit_a, round(nb.s, 6)::double as unit_b from na left join nb using (query_id, item)""",
)
def minmax_fusion(t: Tables) -> DataFrame:
    ev = t.events.select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("item"), "value", F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    a = ev.select("query_id", "item", F.col("value").alias("score"))
    b = ev.where("item % 3 > 0").select("query_id", "item", F.col("k").alias("score"))
    fused = R.minmax_fusion({"a": a, "b": b}, [3.0, 1.0], "item")
    return fused.select("query_id", "item", *[F.round(c, 6).alias(c) for c in ("fused_score", "unit_a", "unit_b")])


@query(
    "rrf_stats",
    "R7",
    _RRF
    + """ select query_id, count(*) as n, round(min(rrf_score), 9) as min_score, round(max(rrf_score), 9) as max_score, round(avg(rrf_score), 9) as avg_score,
  count(rank_a) as n_a, count(rank_b) as n_b from f group by query_id""",
)
def rrf_stats(t: Tables) -> DataFrame:
    s = F.col("rrf_score")
    return R.rrf(_lists(t), [3.0, 2.0], "item").groupBy("query_id").agg(
        F.count("*").alias("n"),
        F.round(F.min(s), 9).alias("min_score"),
        F.round(F.max(s), 9).alias("max_score"),
        F.round(F.avg(s), 9).alias("avg_score"),
        F.count("rank_a").alias("n_a"),
        F.count("rank_b").alias("n_b"),
    )


HYBRID = f"""{BM25}, {DENSE},
fu as (select coalesce(s.query_id, d.query_id) as query_id, coalesce(s.doc_id, d.doc_id) as doc_id, coalesce(s.score, 0) as bm25_score, coalesce(d.score, 0) as dense_score,
   round(coalesce(WS / (60 + s.rank), 0) + coalesce(WD / (60 + d.rank), 0), 9) as rrf_score
  from (select * from bm where rank <= 20) s full join (select * from dn where rank <= 20) d on s.query_id = d.query_id and s.doc_id = d.doc_id),
hy as (select *, row_number() over (partition by query_id order by rrf_score desc, doc_id)::int as rank from fu)"""


@query(
    "hybrid_search",
    "R8",
    f"with {HYBRID.replace('WS', '0.5::double').replace('WD', '0.5::double')} select query_id, doc_id, bm25_score, dense_score, rrf_score, rank from hy where rank <= 10",
)
def hybrid_search(t: Tables) -> DataFrame:
    return R.hybrid(bm25_documents(t, 20), dense_documents(t, 20), "doc_id", 10)


@query(
    "profile_search",
    "R9",
    "with "
    + HYBRID.replace("WS", "(case (coalesce(s.query_id, d.query_id) % 4) when 0 then 0.5 when 1 then 0.7 when 2 then 0.4 else 0.6 end)::double").replace(
        "WD", "(case (coalesce(s.query_id, d.query_id) % 4) when 0 then 0.5 when 1 then 0.3 when 2 then 0.6 else 0.4 end)::double"
    )
    + " select query_id, doc_id, rrf_score, rank from hy where rank <= 10",
)
def profile_search(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(p) for p in ("general", "legal", "technical", "financial")])
    profile = F.element_at(names, (F.col("query_id") % 4 + 1).cast("int"))
    out = R.hybrid(bm25_documents(t, 20), dense_documents(t, 20), "doc_id", 10, profile)
    return out.select("query_id", "doc_id", "rrf_score", "rank")


@query(
    "hybrid_score",
    "R10",
    """select event_id, round(0.6::double * greatest(0, least(1, value / 100)) + 0.4::double * greatest(0, least(1, ((props->>'k')::int - 10) / 80)), 9) as score from events""",
)
def hybrid_score(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select("event_id", F.round(R.hybrid_score(F.col("value") / 100, (k - 10) / 80, 0.6), 9).alias("score"))


def ranked_hits(t: Tables, k: int) -> DataFrame:
    """BM25 hits with the texts of both sides."""
    hits = bm25_documents(t, k)
    q = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return hits.join(t.documents.select("doc_id", "text", "source"), "doc_id").join(q, "query_id").withColumn(
        "page", (F.col("doc_id") % 10).cast("int")
    )


HITS = f"""{BM25}, hits as (select b.query_id, b.doc_id, b.score, b.rank, d.text, d.source, (d.doc_id % 10)::int as page, q.text as question
  from bm b join documents d using (doc_id) join benchmark q on q.item_id = b.query_id where b.rank <= 10)"""


@query(
    "rerank_score",
    "R11",
    f"""with {HITS}, l as (select query_id, doc_id, list_distinct({tokens_sql('question')}) as q, {tokens_sql('text')} as d from hits),
s as (select query_id, doc_id, round(1 / (1 + exp(-greatest(-20, least(20, (len(list_intersect(q, d)) / greatest(len(q), 1) - 0.5) * 8)))), 6) as score from l),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from s where score >= 0.3)
select query_id, doc_id, score, rank from r where rank <= 6""",
)
def rerank_score(t: Tables) -> DataFrame:
    logit = R.lexical_logit(F.col("question"), F.col("text"))
    scored = ranked_hits(t, 10).select("query_id", "doc_id", F.round(R.rerank_score(logit), 6).alias("score"))
    return threshold_top_k(scored, ["query_id"], "score", "doc_id", 6, 0.3)


@query(
    "extractive_answer",
    "R12",
    rf"""with {HITS}, f as (select *, trim(regexp_replace(text, '\s+', ' ', 'g')) as flat from hits),
o as (select query_id, rank, greatest(score, 0) + list_sum(list_transform(list_filter(list_distinct(list_transform(regexp_split_to_array(question, '\s+'), lambda w: lower(w))), lambda w: length(w) > 2),
    lambda w: contains(lower(flat), w)::int)) as o,
   '- ' || trim(split_part(flat, '. ', 1)) || ' [SOURCE: ' || source || ', page ' || (page + 1) || ']' as line from f where flat <> ''),
b as (select *, row_number() over (partition by query_id order by o desc, rank) as rn from o)
select query_id, 'Extractive answer from indexed text:' || chr(10) || string_agg(line, chr(10) order by rn) as answer from b where rn <= 2 group by 1""",
)
def extractive_answer(t: Tables) -> DataFrame:
    return R.extractive_answer(ranked_hits(t, 10))


@query(
    "build_context",
    "R13",
    rf"""with {HITS} select query_id, '<document_context>' || chr(10) || string_agg('[SOURCE: ' || source || ', page ' || (page + 1) || ']' || chr(10) ||
   regexp_replace(text, '([<>&"''\\])', '\\\1', 'g'), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) || chr(10) || '</document_context>' as context,
  count(*) as n_citations, md5(string_agg(rank || '|' || source || '|' || (page + 1) || '|' || doc_id || '|' || text, chr(10) order by rank)) as citations_md5 from hits group by 1""",
)
def build_context(t: Tables) -> DataFrame:
    built = R.build_context(ranked_hits(t, 10))
    line = F.transform("citations", lambda c: F.concat_ws("|", c["rank"], c["source"], c["page"], c["id"], c["text"]))
    return built.select("query_id", "context", "n_citations", F.md5(F.array_join(line, "\n")).alias("citations_md5"))


@query(
    "merge_context",
    "R14",
    f"""with {HITS}, p as (select query_id, string_agg('[SOURCE: ' || source || ', page ' || (page + 1) || ']' || chr(10) || text,
   chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as v from hits group by 1)
select p.query_id, case when p.query_id % 2 = 0 then '=== Knowledge Graph Context ===' || chr(10) || q.text || chr(10) || chr(10) || '===' || chr(10) || chr(10) else '' end ||
   '=== Vector Search Context ===' || chr(10) || v as context from p join benchmark q on q.item_id = p.query_id""",
)
def merge_context(t: Tables) -> DataFrame:
    hits = ranked_hits(t, 10)
    parts = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "source", "page", "text"))),
        lambda s: F.struct(s["source"].alias("source"), s["page"].alias("page"), s["text"].alias("text")),
    )
    g = hits.groupBy("query_id").agg(parts.alias("parts"), F.first("question").alias("q"))
    graph = F.when(F.col("query_id") % 2 == 0, F.col("q"))
    return g.select("query_id", R.merge_context(graph, F.col("parts")).alias("context"))


@query(
    "hash_embed",
    "R15",
    f"with {_embed_cte('dv', 'documents', 'doc_id')} select doc_id, idx, round(s / n, 6) as value from dv_i join dv_n using (doc_id) where s <> 0",
)
def hash_embed(t: Tables) -> DataFrame:
    return V.hash_features(t.documents, "doc_id", word_tokens()).withColumn("value", F.round("value", 6))


ANY = r"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}_\s]', ' ', 'g'), '\s+'), lambda x: x <> ''))"


@query(
    "keyword_kb_search",
    "R18",
    f"""with q as (select item_id as query_id, unnest({ANY}) as tok from benchmark), e as (select conv_id * 1000 + turn as entry_id, unnest({ANY}) as tok from conversations),
h as (select query_id, entry_id, count(*) as overlap from q join e using (tok) group by 1, 2),
r as (select *, row_number() over (partition by query_id order by overlap desc, entry_id)::int as rank from h) select * from r where rank <= 5""",
)
def keyword_kb_search(t: Tables) -> DataFrame:
    kb = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("entry_id"), "text")
    return R.keyword_search(passages(t), kb)


@query(
    "query_cache_keys",
    "R19",
    """with recursive k as (select event_id, ts, sha256(lower(event_type) || '|' || (props->>'k')) as cache_key, value >= 20 as cacheable from events),
opening as (select cache_key, min(ts) as stored_at from k where cacheable group by 1),
stores as (select cache_key, stored_at from opening
  union all
  select s.cache_key, min(k.ts) from stores s join k on k.cache_key = s.cache_key and k.cacheable and k.ts > s.stored_at + interval 30 minutes group by s.cache_key, s.stored_at),
o as (select *, row_number() over (partition by cache_key order by ts, event_id) as rn from k),
w as (select o.cache_key, s.stored_at, min(rn) as stored_by from o join stores s on s.cache_key = o.cache_key and s.stored_at = o.ts where cacheable group by all)
select event_id, o.cache_key, cacheable, exists (select 1 from w where w.cache_key = o.cache_key and w.stored_by < o.rn
  and o.ts >= w.stored_at and o.ts <= w.stored_at + interval 30 minutes) as hit from o""",
)
def query_cache_keys(t: Tables) -> DataFrame:
    k = t.events.select(
        "event_id",
        "ts",
        F.sha2(F.concat_ws("|", F.lower("event_type"), F.get_json_object("props", "$.k")), 256).alias("cache_key"),
        (F.col("value") >= 20).alias("cacheable"),
    )
    replay = cached_replay(k, "cache_key", "ts", "cacheable", "event_id", 1_800)
    return replay.select("event_id", "cache_key", "cacheable", "hit")


@query(
    "mean_vector",
    "R20",
    """select label, (i - 1)::int as idx, round(avg(embedding[i]::double), 6) as value from (select label, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by all""",
)
def mean_vector(t: Tables) -> DataFrame:
    m = V.mean_vectors(t.embeddings, ["label"], "embedding")
    return m.select("label", F.posexplode("embedding").alias("idx", "v")).select("label", "idx", F.round("v", 6).alias("value"))


@query(
    "union_ranked",
    "U1",
    """with a as (select * from (select user_id as query_id, event_id as item, value, row_number() over (partition by user_id order by value desc, event_id) as r from events) where r <= 20),
b as (select * from (select user_id as query_id, event_id as item, (props->>'k')::int as k, row_number() over (partition by user_id order by (props->>'k')::int desc, event_id) as r from events) where r <= 20)
select query_id, item, coalesce(value, 0) as score_a, coalesce(k, 0)::double as score_b from a full join b using (query_id, item)""",
)
def union_ranked(t: Tables) -> DataFrame:
    two = _lists(t)
    a = two["a"].select("query_id", "item", F.col("value").alias("score_a"))
    b = two["b"].select("query_id", "item", F.col("k").cast("double").alias("score_b"))
    return a.join(b, ["query_id", "item"], "full").na.fill(0.0)


@query(
    "re_embed",
    "M4",
    f"""with {_embed_cte('dv', 'documents', 'doc_id')} select d.source, count(*) as n_total, count(n) filter (n > 0) as n_processed, count(*) - count(n) filter (n > 0) as n_failed
 from documents d left join dv_n using (doc_id) group by 1""",
)
def re_embed(t: Tables) -> DataFrame:
    """All documents embedded into a new version; the counts are taken from what is read back."""
    store = VectorStore(t.spark, f"{scratch_folder(t.spark)}/vector-store-2-{files_mark(t, 'documents')}")
    chunks = t.documents.select(F.col("doc_id").alias("key"), "text")
    store.re_embed(chunks, "hash64", lambda df: V.hash_embed(df, "key", word_tokens()), parts=4)
    made = store.vectors().select(F.col("key").alias("doc_id"), F.lit(1).alias("ok"))
    j = t.documents.select("doc_id", "source").join(made, "doc_id", "left")
    return j.groupBy("source").agg(
        F.count("*").alias("n_total"), F.count("ok").alias("n_processed"), (F.count("*") - F.count("ok")).alias("n_failed")
    )
