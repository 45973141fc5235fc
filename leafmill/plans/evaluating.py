"""Registered evaluation: E1-E12, E16, E17, A25, A26, A29-A31."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.functions import vectors as V
from leafmill.operators import chunking as C
from leafmill.operators import evaluation as E
from leafmill.plans.retrieving import _CENTROIDS, _embed_cte, centroids, passages, word_tokens
from leafmill.plans.sqlparts import BLOCKS, words_sql
from leafmill.plans.text import _scrub_sql
from leafmill.operators.retrieval import dense_topk
from leafmill.registry import query
from leafmill.sources.tables import Tables

_E1 = f"""{_CENTROIDS}, k as (select query_id, vec_id, rank, label = query_id as rel from r where rank <= 20),
n as (select label as query_id, count(*) as n_relevant from embeddings group by 1),
p as (select query_id, count(*) filter (rel and rank <= 10) / least(10, count(*)) as precision, count(*) filter (rel and rank <= 10) / any_value(n_relevant) as recall,
  coalesce(1.0::double / min(rank) filter (rel), 0) as reciprocal_rank, count(*) filter (rel and rank <= 10) > 0 as hit, avg(rank) filter (rel) as mean_rank
  from k join n using (query_id) group by query_id)"""


def _per_query(t: Tables) -> DataFrame:
    ranked = dense_topk(centroids(t), t.embeddings, 20)
    truth = t.embeddings.select(F.col("label").alias("query_id"), "vec_id")
    return E.retrieval_metrics(ranked, truth, 10, "vec_id")


@query(
    "retrieval_metrics",
    "E1",
    f"with {_E1} select query_id, round(precision, 6) as precision, round(recall, 6) as recall, round(reciprocal_rank, 6) as reciprocal_rank, hit, round(mean_rank, 6) as mean_rank from p",
)
def retrieval_metrics(t: Tables) -> DataFrame:
    num = ("precision", "recall", "reciprocal_rank", "mean_rank")
    return _per_query(t).withColumns({c: F.round(c, 6) for c in num})


@query(
    "retrieval_suite",
    "A25",
    f"""with {_E1} select count(*) as n_queries, round(avg(precision), 6) as mean_precision, round(avg(recall), 6) as mean_recall,
 round(avg(reciprocal_rank), 6) as mrr, round(avg(hit::int), 6) as hit_rate, count(*) >= 10 as statistically_valid from p""",
)
def retrieval_suite(t: Tables) -> DataFrame:
    return E.retrieval_suite(_per_query(t))


@query("bootstrap_ci", "A26")
def bootstrap_ci(t: Tables) -> DataFrame:
    v = t.events.select("event_type", F.least(F.col("value") / 500, F.lit(1.0)).alias("v"))
    return E.bootstrap_ci(v, ["event_type"], "v")


@query(
    "bootstrap_moments",
    "A26",
    """with v as (select event_type, round(least(value / 500, 1.0), 4) as v from events)
select event_type, count(*) as n, round(avg(v), 4) as mean, round(stddev_pop(v), 4) as std, count(*) >= 5 as statistically_valid,
  true as interval_holds_mean from v group by 1""",
)
def bootstrap_moments(t: Tables) -> DataFrame:
    b = bootstrap_ci(t)
    holds = (F.col("ci_95_lower") <= F.col("mean")) & (F.col("mean") <= F.col("ci_95_upper"))
    return b.select("event_type", "n", "mean", "std", "statistically_valid", holds.alias("interval_holds_mean"))


_SAMPLES = """s as (select conv_id, turn, role, (length(text) % 100) / 100.0::double as faithfulness, (length(text) * 7 % 100) / 100.0::double as answer_relevancy,
  (length(text) * 3 % 100) / 100.0::double as context_precision, (length(text) * 11 % 100) / 100.0::double as context_recall from conversations)"""


def _samples(t: Tables) -> DataFrame:
    n = F.length("text")
    return t.conversations.select(
        "conv_id",
        "turn",
        "role",
        (n % 100 / 100.0).alias("faithfulness"),
        (n * 7 % 100 / 100.0).alias("answer_relevancy"),
        (n * 3 % 100 / 100.0).alias("context_precision"),
        (n * 11 % 100 / 100.0).alias("context_recall"),
    )


@query(
    "rag_report",
    "A29",
    f"""with {_SAMPLES} select role, count(*) as n_samples, round(avg(faithfulness), 4) as mean_faithfulness, round(avg(answer_relevancy), 4) as mean_answer_relevancy,
 round(avg(context_precision), 4) as mean_context_precision, round(avg(context_recall), 4) as mean_context_recall,
 round(avg(faithfulness * 0.35::double + answer_relevancy * 0.25::double + context_precision * 0.25::double + context_recall * 0.15::double), 4) as mean_composite,
 count(*) filter (faithfulness < 0.75) as failing_count, round(count(*) filter (faithfulness < 0.75) / count(*), 4) as failing_ratio,
 avg(faithfulness) < 0.75 as faithfulness_alert from s group by role""",
)
def rag_report(t: Tables) -> DataFrame:
    return E.rag_report(_samples(t), ["role"])


@query(
    "claim_scores",
    "A30",
    r"""with c as (select conv_id, turn, role, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 10) as claims from conversations)
select conv_id, turn, len(claims) as n_claims, case when role = 'system' then 0.0 when len(claims) = 0 then 1.0
  else round(len(list_filter(claims, lambda x: length(x) % 2 = 0)) / len(claims), 6) end::double as faithfulness from c""",
)
def claim_scores(t: Tables) -> DataFrame:
    turns = t.conversations.withColumn("sample", F.struct("conv_id", "turn"))
    claims = turns.select("sample", F.explode(X.sentences(F.col("text"))).alias("c")).where(F.length("c") > 10)
    verdicts = claims.select("sample", (F.length("c") % 2 == 0).alias("supported"))
    scored = E.claim_scores(verdicts, turns.select("sample", (F.col("role") != "system").alias("has_inputs")), "sample")
    return scored.select("sample.conv_id", "sample.turn", "n_claims", F.round("faithfulness", 6).alias("faithfulness"))


_PAIRS = """pr as (select a.conv_id, a.turn, a.text as answer, q.text as question from conversations a join conversations q on q.conv_id = a.conv_id and q.turn = a.turn - 1)"""


def turn_pairs(t: Tables) -> DataFrame:
    """Each turn with the one before it. Texts are dealt to a number of tasks that grows with the table."""
    key = ["conv_id", "turn"]
    a = t.conversations.select(*key, F.col("text").alias("answer"))
    q = t.conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    parts = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * a.rdd.getNumPartitions())
    return a.repartition(parts, *key).join(q.repartition(parts, *key), key)


def _mean_score(*scores: str) -> Column:
    """Mean of scores of six decimals, rounded half up to five: sums of millionths, so no order of adding matters."""
    total = sum((F.round(F.col(c) * 1_000_000).cast("long") for c in scores), F.lit(0))
    n = 10 * len(scores)
    return F.floor((total + n // 2) / n).cast("double") / 100_000


@query(
    "offline_scores",
    "A31",
    f"""with k as (select conv_id * 1000 + turn as id, text from conversations), {_embed_cte('e', 'k', 'id')}, {_PAIRS},
c as (select p.*, c.text as ctx, p.conv_id * 1000 + p.turn - 2 as cid from pr p left join conversations c on c.conv_id = p.conv_id and c.turn = p.turn - 2),
x as (select conv_id, turn, list_distinct({words_sql('lower(answer)')}) as a, list_distinct({words_sql("lower(question || ' ' || coalesce(ctx, ''))")}) as c,
   list_dot_product(ea.v, eq.v) as aq, list_dot_product(ea.v, ec.v) as ac
   from c left join e ea on ea.id = conv_id * 1000 + turn left join e eq on eq.id = conv_id * 1000 + turn - 1 left join e ec on ec.id = cid and ctx is not null)
select conv_id, turn, round(least(1.0, len(list_intersect(a, c)) / (len(a) + 1e-9)), 6) as faithfulness, round(greatest(0, aq), 6) as answer_relevancy,
  round(greatest(0, aq, coalesce(ac, 0)), 6) as context_precision, ((round(round(least(1.0, len(list_intersect(a, c)) / (len(a) + 1e-9)), 6) * 1000000)::bigint
  + round(round(greatest(0, aq), 6) * 1000000)::bigint + round(round(greatest(0, aq, coalesce(ac, 0)), 6) * 1000000)::bigint + 15) // 30)
  / 100000::double as mean_score from x""",
)
def offline_scores(t: Tables) -> DataFrame:
    """Contexts of a turn are the two turns before it; vectors are the hashed ones."""
    keyed = t.conversations.withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    emb = V.hash_embed(keyed, "id", word_tokens())
    older = t.conversations.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("ctx"))
    s = turn_pairs(t).join(older, ["conv_id", "turn"], "left").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    for name, back in (("va", 0), ("vq", 1), ("vc", 2)):
        s = s.join(emb.select((F.col("id") + back).alias("id"), F.col("embedding").alias(name)), "id", "left")
    a = F.array_distinct(X.split_space(F.lower("answer")))
    c = F.array_distinct(X.split_space(F.lower(F.concat_ws(" ", "question", "ctx"))))
    aq = V.dot(F.col("va"), F.col("vq"))
    ac = F.when(F.col("ctx").isNotNull(), V.dot(F.col("va"), F.col("vc")))
    return s.select(
        "conv_id",
        "turn",
        F.round(F.least(F.lit(1.0), F.size(F.array_intersect(a, c)) / (F.size(a) + 1e-9)), 6).alias("faithfulness"),
        F.round(F.greatest(F.lit(0.0), aq), 6).alias("answer_relevancy"),
        F.round(F.greatest(F.lit(0.0), aq, F.coalesce(ac, F.lit(0.0))), 6).alias("context_precision"),
    ).withColumn("mean_score", _mean_score("faithfulness", "answer_relevancy", "context_precision"))


# The oracle's distance counts bytes: accented letters of the lower-cased texts become single bytes that are free.
_ACCENTS = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
_ONE_BYTE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ^{}~`"


def _bytes_sql(col: str) -> str:
    return f"translate({col}, '{_ACCENTS}', '{_ONE_BYTE}')"


def _ocr_lines(t: Tables) -> DataFrame:
    """Every line with a damaged reading of it."""
    truth = F.col("text")
    return C.text_blocks(t.documents).select(
        "doc_id", "block_index", truth.alias("truth"),
        F.when(F.col("block_index") % 9 == 4, "").otherwise(F.replace(F.translate(truth, "ai", "oj"), F.lit("th"), F.lit("t"))).alias("pred"),
    )


@query(
    "cer",
    "E2",
    f"""with {BLOCKS}, l as (select doc_id, block_index, text as truth from blocks),
p as (select *, case when block_index % 9 = 4 then '' else replace(translate(truth, 'ai', 'oj'), 'th', 't') end as pred from l),
n as (select doc_id, block_index, trim(regexp_replace(lower(pred), '\\s+', ' ', 'g')) as p, trim(regexp_replace(lower(truth), '\\s+', ' ', 'g')) as g from p),
r as (select doc_id, block_index, case when g = '' then case when p = '' then 0 else 1 end
   else least(1.0, levenshtein({_bytes_sql('p')}, {_bytes_sql('g')}) / length(g)) end as cer from n)
select doc_id, block_index, round(cer, 6)::double as cer from r""",
)
def cer(t: Tables) -> DataFrame:
    return E.with_cer(_ocr_lines(t), "pred", "truth").select("doc_id", "block_index", F.round("cer", 6).alias("cer"))


# Word-level distance is not available in the oracle; tests compare it with brute force.
@query("wer", "E3")
def wer(t: Tables) -> DataFrame:
    return E.with_wer(_ocr_lines(t), "pred", "truth").select("doc_id", "block_index", F.round("wer", 6).alias("wer"))


@query(
    "match_f1",
    "E4",
    """with j as (select lang, n_chars > 1000 as p, quality = 1 as y, quality = toxic as em from documents join labels using (doc_id)),
c as (select lang, count(*) filter (p and y) as tp, count(*) filter (p and not y) as fp, count(*) filter (not p and y) as fn, round(avg(em::int), 6) as exact_match from j group by 1)
select lang, tp, fp, fn, exact_match, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6)::double as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6)::double as recall,
 round(case when tp > 0 then 2.0::double * tp / (2 * tp + fp + fn) else 0 end, 6) as f1 from c""",
)
def match_f1(t: Tables) -> DataFrame:
    p, y = F.col("n_chars") > 1000, F.col("quality") == 1
    same = X.normalise_text(F.col("quality").cast("string")) == X.normalise_text(F.col("toxic").cast("string"))
    c = t.documents.join(t.labels, "doc_id").groupBy("lang").agg(
        F.count_if(p & y).alias("tp"),
        F.count_if(p & ~y).alias("fp"),
        F.count_if(~p & y).alias("fn"),
        F.round(F.avg(same.cast("int")), 6).alias("exact_match"),
    )
    scores = E.f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.withColumns({n: F.round(s, 6) for n, s in scores.items()})


_GRAMS = f"""{_PAIRS}, w as (select conv_id, turn, {words_sql('lower(answer)')} as h, {words_sql('lower(question)')} as r from pr),
g as (select conv_id, turn, n, array_to_string(list_slice(h, i, i + n - 1), ' ') as gram, 1 as hc, 0 as rc from (select *, unnest(range(1, len(h) - n + 2)) as i from (select *, unnest([1, 2, 3, 4]) as n from w))
  union all select conv_id, turn, n, array_to_string(list_slice(r, i, i + n - 1), ' '), 0, 1 from (select *, unnest(range(1, len(r) - n + 2)) as i from (select *, unnest([1, 2, 3, 4]) as n from w))),
c as (select conv_id, turn, n, gram, sum(hc) as hc, sum(rc) as rc from g group by all),
o as (select conv_id, turn, n, sum(least(hc, rc))::bigint as matched, sum(hc)::bigint as n_hyp, sum(rc)::bigint as n_ref from c group by all)"""


def _overlap(t: Tables) -> DataFrame:
    def toks(c: str):
        return X.split_space(F.lower(c))

    return E.ngram_overlap(turn_pairs(t), ["conv_id", "turn"], toks("answer"), toks("question"))


@query("ngram_overlap", "E5", f"with {_GRAMS} select * from o")
def ngram_overlap(t: Tables) -> DataFrame:
    return _overlap(t)


@query(
    "bleu_rouge1",
    "E5",
    f"""with {_GRAMS},
p as (select conv_id, turn, {', '.join(f'coalesce(max(matched) filter (n = {n}), 0) as m{n}, greatest(coalesce(max(n_hyp) filter (n = {n}), 0), 1) as d{n}' for n in range(1, 5))},
  coalesce(max(n_hyp) filter (n = 1), 0) as h, coalesce(max(n_ref) filter (n = 1), 0) as r from o group by all),
b as (select *, case when h > r then 1.0 when h = 0 then 0.0 else exp(1 - r / h) end as bp,
  case when m1 > 0 then m1 / d1 else 1 end as p1, case when m2 > 0 then m2 / d2 else 1 / (2 * d2) end as p2,
  case when m3 > 0 then m3 / d3 else 1 / (pow(2, 1 + (m2 = 0)::int) * d3) end as p3,
  case when m4 > 0 then m4 / d4 else 1 / (pow(2, 1 + (m2 = 0)::int + (m3 = 0)::int) * d4) end as p4 from p)
select conv_id, turn, round(case when m1 > 0 then bp * m1 / d1 else 0 end, 6)::double as bleu_1,
  round(case when m1 > 0 then bp * exp(0.25 * (ln(p1) + ln(p2) + ln(p3) + ln(p4))) else 0 end, 6)::double as bleu_4,
  round(case when m1 > 0 and r > 0 then 2.0 * m1 / (h + r) else 0 end, 6)::double as rouge_1 from b""",
)
def bleu_rouge1(t: Tables) -> DataFrame:
    key = ["conv_id", "turn"]
    return E.bleu_rouge1(_overlap(t), key).select(*key, *[F.round(c, 6).alias(c) for c in ("bleu_1", "bleu_4", "rouge_1")])


@query("rouge_l", "E5")
def rouge_l(t: Tables) -> DataFrame:
    p = turn_pairs(t)
    return p.select(
        "conv_id", "turn", F.round(E.rouge_l(X.tokenize_any(F.col("answer")), X.tokenize_any(F.col("question"))), 6).alias("rouge_l")
    )


@query(
    "answer_relevancy",
    "E6",
    f"with {_CENTROIDS} select query_id, count(*) as n_generated, round(avg(greatest(0, list_cosine_similarity(embedding::double[], v))), 6) as relevancy from embeddings, c where label = query_id group by 1",
)
def answer_relevancy(t: Tables) -> DataFrame:
    q = centroids(t).withColumnRenamed("embedding", "q")
    g = t.embeddings.select(F.col("label").alias("query_id"), "embedding")
    flat = (V.norm(F.col("q")) < 1e-9) | (V.norm(F.col("embedding")) < 1e-9)
    sim = F.when(flat, 0.5).otherwise(F.greatest(F.lit(0.0), V.cosine(F.col("q"), F.col("embedding"))))
    return g.join(q, "query_id").groupBy("query_id").agg(
        F.count("*").alias("n_generated"), F.round(F.avg(sim), 6).alias("relevancy")
    )


@query(
    "split_sentences",
    "E7",
    r"""with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
   lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 10) as s from documents)
select doc_id, len(s)::int as n_sentences, md5(array_to_string(s, '|')) as sentences_md5 from s""",
)
def split_sentences(t: Tables) -> DataFrame:
    s = F.filter(X.sentences(F.col("text")), lambda x: F.length(x) > 10)
    return t.documents.select("doc_id", F.size(s).alias("n_sentences"), F.md5(F.array_join(s, "|")).alias("sentences_md5"))


_MEANS = f"{_SAMPLES}, m as (select conv_id, avg(faithfulness) as faithfulness, avg(answer_relevancy) as answer_relevancy, avg(context_precision) as context_precision, avg(context_recall) as context_recall from s group by 1)"


def _means(t: Tables) -> DataFrame:
    return _samples(t).groupBy("conv_id").agg(*[F.avg(m).alias(m) for m in E.ALERT_LEVELS])


@query(
    "threshold_alerts",
    "E8",
    f"""with {_MEANS}, u as (select conv_id, unnest(['faithfulness', 'answer_relevancy', 'context_precision', 'context_recall']) as metric,
  unnest([faithfulness, answer_relevancy, context_precision, context_recall]) as value, unnest([0.75, 0.65, 0.60, 0.55])::double as w, unnest([0.60, 0.50, 0.45, 0.40])::double as c from m)
select conv_id, metric, round(round(value, 9) + 1e-9, 4) as value, case when value < c then 'critical' else 'warning' end as severity, case when value < c then c else w end as threshold from u where value < w""",
)
def threshold_alerts(t: Tables) -> DataFrame:
    return E.threshold_alerts(_means(t), ["conv_id"])


@query(
    "quality_gate",
    "E9",
    f"""with {_MEANS}, x as (select *, round((faithfulness + answer_relevancy + context_precision) / 3, 6) as composite from m),
u as (select conv_id, unnest(['faithfulness', 'answer_relevancy', 'context_precision', 'composite']) as metric, unnest([faithfulness, answer_relevancy, context_precision, composite]) as value,
  unnest([0.60, 0.55, 0.50, 0.55])::double as threshold from x)
select conv_id, metric, round(value, 6) as value, threshold, value >= threshold as passed from u""",
)
def quality_gate(t: Tables) -> DataFrame:
    m = _means(t)
    three = [F.col(c) for c in ("faithfulness", "answer_relevancy", "context_precision")]
    g = E.quality_gate(m.withColumn("composite", E.mean_available(*three)), ["conv_id"])
    return g.withColumn("value", F.round("value", 6))


@query(
    "composite",
    "E10",
    f"""with {_SAMPLES} select conv_id, turn, round(coalesce(list_avg(list_filter([case when turn % 3 = 0 then null else faithfulness end, case when turn % 2 = 0 then null else answer_relevancy end,
  case when role = 'system' then null else context_precision end], lambda x: x is not null)), 0), 6) as composite from s""",
)
def composite(t: Tables) -> DataFrame:
    c = E.mean_available(
        F.when(F.col("turn") % 3 != 0, F.col("faithfulness")),
        F.when(F.col("turn") % 2 != 0, F.col("answer_relevancy")),
        F.when(F.col("role") != "system", F.col("context_precision")),
    )
    return _samples(t).select("conv_id", "turn", c.alias("composite"))


@query(
    "triplets",
    "E11",
    f"""with {BLOCKS}, b as (select doc_id as source, doc_id * 100000 + block_index as seq, text from blocks),
a as (select * from b where length(text) > 50), u as (select * from b where length(text) > 30),
same as (select a.source, a.seq, u.seq as q, u.text as t, 0 as grp from a join u on u.source = a.source and u.text <> a.text),
heads as (select source, seq, text from (select *, row_number() over (partition by source order by seq) as rn from u) where rn <= 5 order by seq limit 10),
oth as (select a.source, a.seq, h.seq as q, h.text as t, 1 as grp from a join heads h on h.source <> a.source),
r as (select *, row_number() over (partition by seq order by grp, q) as rn from (select * from same union all select * from oth)),
l as (select source, seq, list(q order by rn) as qs, list(t order by rn) as ts from r where rn <= 5 group by all)
select a.source, a.seq, a.text as positive, coalesce(len(qs), 0)::int as n_candidates, qs[(a.seq % len(qs) + 1)::int] as negative_seq,
  ts[(a.seq % len(qs) + 1)::int] as negative from a left join l using (seq)""",
)
def triplets(t: Tables) -> DataFrame:
    chunks = C.text_blocks(t.documents).select(
        F.col("doc_id").alias("source"), (F.col("doc_id") * 100000 + F.col("block_index")).alias("seq"), "text"
    )
    return E.triplets(chunks)


@query(
    "train_val_split",
    "E12",
    """with h as (select doc_id, md5(doc_id || '|42') as h from documents), r as (select *, row_number() over (order by h, doc_id) as rn from h)
select doc_id, case when rn <= greatest(1, floor((select count(*) from documents) * 0.1)) then 'val' else 'train' end as split from r""",
)
def train_val_split(t: Tables) -> DataFrame:
    return E.train_val_split(t.documents.select("doc_id"), "doc_id")


@query(
    "eval_examples",
    "E16",
    f"""with e as (select conv_id, turn, text, case when turn % 5 = 4 then null else text end as question, case when turn % 7 = 3 then ' ' else text end as truth from conversations)
select conv_id, turn, concat_ws('|', case when question is null then 'missing question' end, case when trim(truth) = '' then 'empty ground_truth' end) as reasons,
  case when question is not null and trim(truth) <> '' then md5({_scrub_sql('truth')}) end as truth_md5 from e""",
)
def eval_examples(t: Tables) -> DataFrame:
    e = t.conversations.select(
        "conv_id",
        "turn",
        F.when(F.col("turn") % 5 != 4, F.col("text")).alias("question"),
        F.when(F.col("turn") % 7 == 3, " ").otherwise(F.col("text")).alias("truth"),
    )
    no_q, no_t = F.col("question").isNull(), X.strip(F.col("truth")) == ""
    reasons = F.concat_ws("|", F.when(no_q, "missing question"), F.when(no_t, "empty ground_truth"))
    clean = F.when(~no_q & ~no_t, F.md5(X.scrub_pii(F.col("truth"))))
    return e.select("conv_id", "turn", reasons.alias("reasons"), clean.alias("truth_md5"))


@query(
    "relevance_truth",
    "E17",
    "select item_id as query_id, doc_id from benchmark b join documents d on contains(d.text, b.text)",
)
def relevance_truth(t: Tables) -> DataFrame:
    return E.containing_documents(passages(t), t.documents)
