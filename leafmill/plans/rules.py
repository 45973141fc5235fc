"""Registered domain rules: A15, A16, J8-J10, J14, X1-X4, X6-X11."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import patterns as P
from leafmill.functions import text as X
from leafmill.operators import chunking as C
from leafmill.operators import joins as J
from leafmill.operators import rules as R
from leafmill.operators.ranking import top_k_per_key
from leafmill.plans.sqlparts import BLOCKS, any_of, quote
from leafmill.registry import query
from leafmill.sources.tables import Tables

_CL = f"""cl as (select l_orderkey as contract, l_linenumber * 1000000 + l_partkey as id, [{', '.join(quote(c) for c in P.CLAUSE_TYPES)}][(l_partkey % 15 + 1)::int] as clause_type,
   case when l_partkey % 17 = 0 then null else l_quantity / 4 end as risk_score from lineitem)"""


def contract_clauses(t: Tables) -> DataFrame:
    kinds = F.array(*[F.lit(c) for c in P.CLAUSE_TYPES])
    return t.lineitem.select(
        F.col("l_orderkey").alias("contract"),
        (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("id"),
        F.element_at(kinds, (F.col("l_partkey") % 15 + 1).cast("int")).alias("clause_type"),
        F.when(F.col("l_partkey") % 17 != 0, F.col("l_quantity") / 4).alias("risk_score"),
    )


@query(
    "risk_rollup",
    "A15",
    f"""with {_CL}, s as (select *, greatest(1.0, least(10.0, coalesce(risk_score, 5.0)))::double as s,
  case clause_type when 'liability_cap' then 20 when 'indemnification' then 20 when 'termination' then 15 when 'payment_terms' then 15 when 'governing_law' then 12 else 10 end as w from cl),
g as (select contract, count(*) as n_clauses, sum(s * w) / sum(w) as base, 6 - count(distinct clause_type) filter (clause_type in ({', '.join(quote(c) for c in P.STANDARD_CLAUSES)})) as n_missing,
  count(*) filter (s >= 9) as n_critical, count(*) filter (s >= 7 and s < 9) as n_high from s group by 1),
r as (select *, round(least(10.0, base + n_missing * 0.5::double), 6) as risk from g)
select contract, n_clauses, n_missing, n_critical, n_high, risk, case when risk >= 7.5 then 'critical' when risk >= 5.5 then 'high' when risk >= 3.5 then 'medium' else 'low' end as level from r""",
)
def risk_rollup(t: Tables) -> DataFrame:
    return R.risk_rollup(contract_clauses(t), "contract")


@query(
    "missing_clauses",
    "A16",
    f"""with {_CL}, k as (select distinct contract from cl), m as (select k.contract, s.c, s.i from k, (select unnest([{', '.join(quote(c) for c in P.STANDARD_CLAUSES)}]) as c, unnest(range(6)) as i) s
  where not exists (select 1 from cl where cl.contract = k.contract and clause_type = s.c))
select k.contract, coalesce(string_agg(c, ',' order by i), '') as missing from k left join m using (contract) group by 1""",
)
def missing_clauses(t: Tables) -> DataFrame:
    return R.missing_clauses(contract_clauses(t), "contract").select("contract", F.array_join("missing", ",").alias("missing"))


@query(
    "highest_risk_clauses",
    "A16",
    f"""with {_CL}, r as (select *, row_number() over (partition by contract order by coalesce(risk_score, 0) desc, id)::int as rank from cl)
select contract, id, clause_type, rank from r where rank <= 5""",
)
def highest_risk_clauses(t: Tables) -> DataFrame:
    cl = contract_clauses(t).withColumn("s", F.coalesce("risk_score", F.lit(0.0)))
    return top_k_per_key(cl, ["contract"], "s", "id", 5).select("contract", "id", "clause_type", "rank")


def _po_side(name: str, seq: str, text: str, price: str, kept: str = "true") -> str:
    key = f"printf('%010d-%08d-%08d-%012d', {seq}, l_partkey, l_suppkey, round(l_extendedprice * 100)::bigint)"
    return f"""{name} as (select l_orderkey as invoice, {key} as seq, case when l_partkey % 4 = 0 then printf('%06d', l_partkey) else '' end as sku,
   list_distinct(string_split(lower(case when l_partkey % 4 = 0 then 'SKU ' || printf('%06d', l_partkey) || ' ' else '' end || {text}), ' ')) as words,
   {price} as price from lineitem join part on p_partkey = l_partkey where {kept})"""


_PO_TEXT = """split_part(p_name, ' ', 2) || ' ' || p_type || ' part of grade g' || p_size % 2 || ' for {} p' || l_suppkey % 2"""
# The oracle walks each invoice line by line; a line's candidates come as one list in the order of its choice.
_PO = f"""{_po_side("ln", "l_linenumber", _PO_TEXT.format("plant"), "l_extendedprice / l_quantity")},
{_po_side("po", "9 - l_linenumber", _PO_TEXT.format("plant").replace("plant", "' || case when l_suppkey % 5 = 0 then 'site' else 'plant' end || '"), "p_retailprice * 30", "l_returnflag <> 'R'")},
cand as (select ln.invoice, ln.seq as inv_seq, po.seq as po_seq, po.price, case when ln.sku <> '' and ln.sku = po.sku then 'exact' else 'fuzzy' end as match,
   case when ln.sku <> '' and ln.sku = po.sku then 1.0 else len(list_intersect(ln.words, po.words)) / greatest(len(ln.words), len(po.words)) end::double as score from ln join po using (invoice)),
lists as (select invoice, inv_seq, list({{'po_seq': po_seq, 'price': price, 'match': match, 'score': score}} order by score desc, po_seq) as c from cand where score >= 0.85 group by all),
num as (select ln.invoice, ln.seq as inv_seq, ln.price, coalesce(c, []) as c, row_number() over (partition by ln.invoice order by ln.seq) as n from ln left join lists on lists.invoice = ln.invoice and lists.inv_seq = ln.seq),
walk as (select invoice, inv_seq, price, n, c[1] as got, case when len(c) > 0 then [c[1].po_seq] else [] end as used from num where n = 1
  union all select num.invoice, num.inv_seq, num.price, num.n, list_filter(num.c, lambda x: not list_contains(walk.used, x.po_seq))[1],
    list_concat(walk.used, list_transform(list_filter(num.c, lambda x: not list_contains(walk.used, x.po_seq))[1:1], lambda x: x.po_seq))
  from walk join num on num.invoice = walk.invoice and num.n = walk.n + 1)"""


@query(
    "po_match",
    "J8",
    f"""with recursive {_PO} select invoice, inv_seq, got.po_seq as po_seq, coalesce(got.match, 'none') as match, round(coalesce(got.score, 0), 9) as score,
  case when got is not null then got.price > 0 and abs(price - got.price) > 0.05::double * got.price end as price_mismatch from walk""",
)
def po_match(t: Tables) -> DataFrame:
    """Lines and order lines whose texts differ in a word or two, so that many lines compete for an order line."""
    j = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    sku = F.when(F.col("l_partkey") % 4 == 0, F.format_string("SKU %06d ", F.col("l_partkey"))).otherwise("")

    def text(place):
        noun = F.element_at(F.split("p_name", " "), 2)
        parts = [sku, noun, F.lit(" "), F.col("p_type"), F.lit(" part of grade g"), F.col("p_size") % 2, F.lit(" for "), place, F.lit(" p"), F.col("l_suppkey") % 2]
        return F.concat(*parts)

    def seq(line):
        cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        return F.format_string("%010d-%08d-%08d-%012d", line, F.col("l_partkey"), F.col("l_suppkey"), cents)

    lines = j.select(
        F.col("l_orderkey").alias("invoice"), seq(F.col("l_linenumber")).alias("inv_seq"), text(F.lit("plant")).alias("inv_text"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
    )
    place = F.when(F.col("l_suppkey") % 5 == 0, "site").otherwise("plant")
    po = j.where("l_returnflag <> 'R'").select(
        F.col("l_orderkey").alias("invoice"), seq(9 - F.col("l_linenumber")).alias("po_seq"), text(place).alias("po_text"),
        (F.col("p_retailprice") * 30).alias("po_price"),
    )
    return R.po_match(lines, po).withColumn("score", F.round("score", 9)).select("invoice", "inv_seq", "po_seq", "match", "score", "price_mismatch")


_INV = """inv as (select o_orderkey as file, 'INV-' || (o_orderkey * 7 % 12000) as number, 'Vendor ' || (o_custkey % 50) as vendor, floor(o_totalprice / 5000) * 5000 as amount, o_orderdate as date,
  coalesce(e, 0) as expected, case when o_orderpriority = '5-LOW' then null else 'PO' || o_orderkey end as po_number, o_orderdate + to_days((o_custkey % 40 - 5)::int) as due_date, coalesce(n, 0) as n_lines
  from orders left join (select l_orderkey, sum(l_extendedprice) as e, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey),
d1 as (select i.file, 'critical' as severity from inv i where exists (select 1 from inv h where h.number = i.number and h.file <> i.file)),
d2 as (select i.file, 'high' as severity from inv i where i.file not in (select file from d1) and exists (select 1 from inv h where lower(h.vendor) = lower(i.vendor) and h.date = i.date and abs(h.amount - i.amount) < 0.01 and h.file <> i.file))"""


def invoices(t: Tables) -> DataFrame:
    agg = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_extendedprice").alias("expected"), F.count("*").alias("n_lines")
    )
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.join(agg, "o_orderkey", "left").select(
        k.alias("file"),
        F.concat(F.lit("INV-"), k * 7 % 12000).alias("number"),
        F.concat(F.lit("Vendor "), c % 50).alias("vendor"),
        (F.floor(F.col("o_totalprice") / 5000) * 5000).cast("double").alias("amount"),
        F.col("o_orderdate").alias("date"),
        F.coalesce("expected", F.lit(0.0)).alias("expected"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("PO"), k)).alias("po_number"),
        (F.col("o_orderdate") + F.make_dt_interval((c % 40 - 5).cast("int"))).alias("due_date"),
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
    )


@query("duplicate_invoices", "J9", f"with {_INV} select file, severity from d1 union all select file, severity from d2")
def duplicate_invoices(t: Tables) -> DataFrame:
    return R.duplicate_invoices(invoices(t)).select("file", "severity")


@query(
    "invoice_anomalies",
    "X1",
    f"""with {_INV} select file, 'duplicate' as anomaly, severity from d1 union all select file, 'duplicate', severity from d2
union all select file, 'amount_deviation', case when abs(amount - expected) / expected > 0.25 then 'critical' else 'high' end from inv where expected > 0 and amount > 0 and abs(amount - expected) / expected > 0.10
union all select file, 'missing_po', 'medium' from inv where po_number is null and amount > 1000
union all select file, 'old_invoice', 'medium' from inv where date_diff('day', date, timestamp '2001-08-01') > 90
union all select file, 'due_before_date', 'high' from inv where due_date < date
union all select file, 'round_number', 'low' from inv where amount >= 1000 and amount % 100 = 0 and n_lines <= 1""",
)
def invoice_anomalies(t: Tables) -> DataFrame:
    return R.invoice_anomalies(invoices(t), F.expr("timestamp_ntz'2001-08-01'"))


@query(
    "invoice_complete",
    "X2",
    """select o_orderkey as file, o_orderkey % 9 <> 0 and o_custkey % 8 <> 0 and o_totalprice > 1000 as complete from orders""",
)
def invoice_complete(t: Tables) -> DataFrame:
    inv = t.orders.select(
        F.col("o_orderkey").alias("file"),
        F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderkey")).alias("number"),
        F.col("o_orderdate").alias("date"),
        F.when(F.col("o_custkey") % 8 == 0, "").otherwise("v").alias("vendor"),
        F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")).otherwise(0.0).alias("amount"),
    )
    return inv.select("file", R.invoice_complete().alias("complete"))


_BOX = """bx as (select l_orderkey as page, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey as id, (l_partkey % 200)::double as x1, (l_linenumber * 20)::double as y1,
  (l_partkey % 200 + 60)::double as x2, (l_linenumber * 20 + 15)::double as y2, l_linenumber as line, 'part ' || l_partkey as text, l_quantity / 50 as ca, (100 - l_quantity) / 100 as cb,
  (l_suppkey % 5) * 8.0::double as dx, (l_suppkey % 4) * 2.0::double as dy from lineitem)"""


def _boxes(t: Tables) -> tuple[DataFrame, DataFrame]:
    li = t.lineitem
    x, y = (F.col("l_partkey") % 200).cast("double"), (F.col("l_linenumber") * 20).cast("double")
    ids = (F.col("l_linenumber").cast("bigint") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("id")
    dx, dy = (F.col("l_suppkey") % 5) * 8.0, (F.col("l_suppkey") % 4) * 2.0

    def box(ox, oy):
        return F.struct((x + ox).alias("x1"), (y + oy).alias("y1"), (x + 60 + ox).alias("x2"), (y + 15 + oy).alias("y2")).alias("box")

    base = [F.col("l_orderkey").alias("page"), ids, F.col("l_linenumber").alias("line"), F.concat(F.lit("part "), "l_partkey").alias("text")]
    a = li.select(*base, box(F.lit(0.0), F.lit(0.0)), (F.col("l_quantity") / 50).alias("confidence"))
    b = li.select(*base, box(dx, dy), ((100 - F.col("l_quantity")) / 100).alias("confidence"))
    return a, b


@query(
    "iou_pairs",
    "J10",
    f"""with {_BOX}, p as (select a.page, a.id as id_a, b.id as id_b, greatest(least(a.x2, b.x2 + b.dx) - greatest(a.x1, b.x1 + b.dx), 0) * greatest(least(a.y2, b.y2 + b.dy) - greatest(a.y1, b.y1 + b.dy), 0) as i
   from bx a join bx b on a.page = b.page), q as (select *, i / (1800 - i) as iou from p)
select page, id_a, id_b, round(iou, 6) as iou from q where iou > 0.5""",
)
def iou_pairs(t: Tables) -> DataFrame:
    return R.iou_pairs(*_boxes(t)).withColumn("iou", F.round("iou", 6))


# The greedy merge has no SQL form; tests compare it with brute force.
@query("iou_block_merge", "J10")
def iou_block_merge(t: Tables) -> DataFrame:
    return R.iou_block_merge(*_boxes(t))


@query(
    "interaction_pairs",
    "J14",
    """with m as (select distinct l_suppkey as patient_id, lower(p_name) as name from lineitem join part on p_partkey = l_partkey),
i as (select least(a, b) as a, greatest(a, b) as b, severity from (select lower(p_name) as a, lower(p_type) as b0, p_partkey, lead(lower(p_name)) over (order by p_partkey) as b,
   case p_partkey % 3 when 0 then 'major' when 1 then 'moderate' end as severity from part)),
d as (select a, b, max(case severity when 'major' then 2 when 'moderate' then 1 else 0 end) as s from i where b is not null and a <> b group by 1, 2)
select m1.patient_id, count(*) as n_interactions, count(*) filter (s = 2) as n_major, count(*) filter (s = 1) as n_moderate from d join m m1 on m1.name = d.a join m m2 on m2.patient_id = m1.patient_id and m2.name = d.b group by 1""",
)
def interaction_pairs(t: Tables) -> DataFrame:
    meds = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_suppkey").alias("patient_id"), F.col("p_name").alias("name")
    )
    # neighbouring parts stand in for the interaction table
    p = t.part.select("p_partkey", F.lower("p_name").alias("x"))
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("x").alias("y"))
    sev = F.when(F.col("p_partkey") % 3 == 0, 2).when(F.col("p_partkey") % 3 == 1, 1).otherwise(0)
    known = (
        p.join(nxt, "p_partkey").where("x <> y")
        .groupBy(F.least("x", "y").alias("drug_1"), F.greatest("x", "y").alias("drug_2"))
        .agg(F.max(sev).alias("s"))
        .withColumn("severity", F.when(F.col("s") == 2, "major").when(F.col("s") == 1, "moderate"))
    )
    hits = J.interaction_matches(meds, known)
    return hits.groupBy("patient_id").agg(
        F.count("*").alias("n_interactions"),
        F.count_if(F.col("severity") == "major").alias("n_major"),
        F.count_if(F.col("severity") == "moderate").alias("n_moderate"),
    )


_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "gst_checks",
    "X3",
    """with g as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('%02d', l_suppkey % 45) || 'ABCDE1234F1' || case when l_suppkey % 10 = 3 then 'Y' else 'Z' end || '5' as gstin,
  round(l_extendedprice * l_tax, 2) + (l_partkey % 4 = 0)::int * 2.5 as tax, l_extendedprice as taxable, round(l_tax * 100) as rate, case when l_partkey % 6 = 0 then '' else 'H' end as hsn from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'gstin_invalid' as type, 'high' as severity from g where not (regexp_full_match(gstin, '\\d{2}[A-Z]{5}\\d{4}[A-Z][A-Z\\d]Z[A-Z\\d]') and substr(gstin, 1, 2)::int between 1 and 38)
union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'tax_calculation_error', 'high' from g where taxable > 0 and rate > 0 and abs(tax - round(taxable * rate / 100, 2)) > 1.0
union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'missing_hsn', 'medium' from g where hsn = ''""",
)
def gst_checks(t: Tables) -> DataFrame:
    letter = F.when(F.col("l_suppkey") % 10 == 3, "Y").otherwise("Z")
    lines = t.lineitem.select(
        *_KEYS,
        F.concat(F.format_string("%02d", F.col("l_suppkey") % 45), F.lit("ABCDE1234F1"), letter, F.lit("5")).alias("gstin"),
        F.col("l_extendedprice").alias("taxable"),
        F.round(F.col("l_tax") * 100).alias("rate"),
        (F.round(F.col("l_extendedprice") * F.col("l_tax"), 2) + (F.col("l_partkey") % 4 == 0).cast("int") * 2.5).alias("tax"),
        F.when(F.col("l_partkey") % 6 == 0, "").otherwise("H").alias("hsn"),
    )
    return R.gst_checks(lines, list(_KEYS))


@query(
    "gst_split",
    "X4",
    """with a as (select o_orderkey, floor(o_totalprice)::double as amount, o_custkey % 5 = o_orderkey % 5 as same from orders), g as (select *, round_even(amount * 0.18::double, 2) as gst from a)
select o_orderkey, case when same then round_even(gst / 2, 2) else 0 end::double as cgst, case when same then round_even(gst / 2, 2) else 0 end::double as sgst, case when same then 0 else gst end::double as igst,
  gst as total_gst, round_even(amount + gst, 2) as total from g""",
)
def gst_split(t: Tables) -> DataFrame:
    s = R.gst_split(F.floor("o_totalprice").cast("double"), F.col("o_custkey") % 5, F.col("o_orderkey") % 5)
    return t.orders.select("o_orderkey", *[c.alias(n) for n, c in s.items()])


@query(
    "bbox_normalise",
    "X6",
    """with b as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber::double as x, l_partkey::double as y, l_partkey % 4 as kind from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case kind when 3 then 0 else x end::double as x1, case kind when 3 then 0 else y end::double as y1,
 case kind when 3 then 100 else x + 10 end::double as x3, case kind when 3 then 100 else y + 5 end::double as y3 from b""",
)
def bbox_normalise(t: Tables) -> DataFrame:
    x, y = F.col("l_linenumber").cast("double"), F.col("l_partkey").cast("double")
    a = F.array
    pts = (
        F.when(F.col("l_partkey") % 4 == 0, a(a(x, y), a(x + 10, y), a(x + 10, y + 5), a(x, y + 5)))
        .when(F.col("l_partkey") % 4 == 1, a(a(x), a(y), a(x + 10), a(y + 5)))
        .when(F.col("l_partkey") % 4 == 2, a(a(x, y), a(x + 10, y + 5)))
        .otherwise(a(a(x, y, y)))
    )
    b = t.lineitem.select(*_KEYS, R.bbox_normalise(pts).alias("b"))
    at = lambda i, j: F.get(F.get("b", F.lit(i)), F.lit(j))
    return b.select(*_KEYS, at(0, 0).alias("x1"), at(0, 1).alias("y1"), at(2, 0).alias("x3"), at(2, 1).alias("y3"))


@query(
    "template_check",
    "X7",
    """select o_orderkey, 'vendor' as field, 'missing_required' as problem from orders where o_custkey % 7 = 0
union all select o_orderkey, 'date', 'bad_type' from orders where o_orderkey % 8 = 0
union all select o_orderkey, 'total', 'bad_type' from orders where o_orderkey % 5 = 0
union all select o_orderkey, 'total', 'low_confidence' from orders where o_orderkey % 5 <> 0 and o_totalprice < 20000""",
)
def template_check(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    conf = F.when(F.col("o_totalprice") < 20000, 0.2).otherwise(0.9)
    def cell(field: str, value, confidence):
        return F.struct(F.lit(field).alias("field"), value.alias("value"), confidence.alias("confidence"))

    cells = F.array(
        cell("vendor", F.when(F.col("o_custkey") % 7 == 0, " ").otherwise("acme"), F.lit(0.9)),
        cell("date", F.when(k % 8 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit(0.9)),
        cell("total", F.when(k % 5 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")), conf),
        cell("note", F.lit(None).cast("string"), F.lit(0.0)),
    )
    v = t.orders.select("o_orderkey", F.explode(cells).alias("c")).select("o_orderkey", "c.*")
    spec = [("vendor", "string", True), ("date", "date", True), ("total", "number", True), ("note", "string", False)]
    return R.template_check(v, ["o_orderkey"], spec)


_TITLES = ("Liability cap for parties", "Termination by notice", "Payment on receipt", "Governing law and venue", "Other matters here")
_CHUNK_SQL = f"""ck as (select doc_id, block_index, 'Section ' || (block_index + 1) || ': ' || [{', '.join(quote(x) for x in _TITLES)}][(block_index % 5 + 1)::int] || '. The parties shall agree. ' || text as text from blocks)"""


def _contract_chunks(t: Tables) -> DataFrame:
    titles = F.array(*[F.lit(x) for x in _TITLES])
    i = F.col("block_index")
    return C.text_blocks(t.documents).select(
        "doc_id",
        "block_index",
        F.concat(F.lit("Section "), i + 1, F.lit(": "), F.element_at(titles, i % 5 + 1), F.lit(". The parties shall agree. "), "text").alias("text"),
    )


@query(
    "clauses",
    "X8",
    rf"""with {BLOCKS}, {_CHUNK_SQL}, g as (select doc_id, (block_index // 3)::bigint as grp, string_agg(text, chr(10) || chr(10) order by block_index) as txt from ck group by all),
h as (select doc_id, grp, txt, regexp_extract_all(txt, '(?:Section|Article|Clause|§)\s*[\d\.]+[A-Za-z]?\s*[:\.]?\s*([A-Z][^\.]{{5,80}})', 1) || regexp_extract_all(txt, '\b(?:WHEREAS|NOW,?\s+THEREFORE|IN\s+WITNESS)\b')
   || regexp_extract_all(txt, '\b(?:\d+\.\d+)\s+([A-Z][a-z][\w\s]{{5,60}})\b', 1) as h from g),
e as (select doc_id, grp, i::int as pos, h[i + 1] as title, txt, instr(txt, h[i + 1]) as s, list_transform(h, lambda t: instr(txt, t)) as places from (select *, unnest(range(len(h))) as i from h)),
c as (select *, substr(txt, s, coalesce(list_min(list_filter(places, lambda p: p > s)), length(txt) + 1) - s) as clause_text from e)
select doc_id, grp, pos, title, clause_text, case {' '.join(f"when contains(lower(title), '{w}') then '{k}'" for w, k in R.CLAUSE_WORDS)} else 'other' end as clause_type from c""",
)
def clauses(t: Tables) -> DataFrame:
    return R.clauses(_contract_chunks(t), "doc_id", "block_index", "text")


@query(
    "obligations",
    "X9",
    rf"""with {BLOCKS}, {_CHUNK_SQL}, s as (select doc_id, block_index, list_filter(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
   lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), lambda x: {any_of('lower(x)', P.OBLIGATION_WORDS)}) as s from ck where {any_of('lower(text)', P.OBLIGATION_WORDS)}),
e as (select doc_id, block_index, unnest(range(len(s))) as i, s from s)
select doc_id, block_index, i::int as pos, regexp_extract(s[i + 1], '^((?:The )?[A-Z][\w]*)', 1) as party, s[i + 1] as obligation from e""",
)
def obligations(t: Tables) -> DataFrame:
    return R.obligations(_contract_chunks(t), ["doc_id", "block_index"], "text")


@query(
    "clinical_codes",
    "X10",
    f"""with {BLOCKS}, c as (select doc_id, block_index, 'Diagnosis ' || ['E11.9', 'I10', 'J45.909', 'M54.5'][(block_index % 4 + 1)::int] || ' and Z79.4: ' || text as text from blocks),
h as (select doc_id, block_index, text, regexp_extract_all(text, {quote(R.CODE_SHAPE)}) as h from c where {any_of('lower(text)', P.CLINICAL_WORDS)}),
e as (select doc_id, block_index, text, i as pos, h[i + 1] as code from (select *, unnest(range(len(h))) as i from h)),
r as (select *, row_number() over (partition by doc_id, code order by block_index, pos) as rn from e)
select doc_id, code, block_index, text as evidence, 0.8::double as confidence from r where rn = 1""",
)
def clinical_codes(t: Tables) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in ("E11.9", "I10", "J45.909", "M54.5")])
    ch = C.text_blocks(t.documents).select(
        "doc_id",
        "block_index",
        F.concat(F.lit("Diagnosis "), F.element_at(codes, F.col("block_index") % 4 + 1), F.lit(" and Z79.4: "), "text").alias("text"),
    )
    return R.clinical_codes(ch, "doc_id", "block_index", "text")


@query(
    "invoice_from_fields",
    "X11",
    """select o_orderkey, case when o_orderkey % 6 = 0 then null else 'INV-' || o_orderkey end as invoice_number, 'Vendor ' || (o_custkey % 50) as vendor_name,
 case when o_orderkey % 4 = 0 then 'INR' else 'USD' end as currency, 0.0::double as tax_amount, case when o_orderkey % 10 = 0 then 0.0 else floor(o_totalprice) end::double as total_amount,
 1 as n_items, (o_custkey % 7 * 10)::double as items_total, (2 + (o_orderkey % 6 <> 0)::int + (o_orderkey % 10 <> 0)::int) / 4 as confidence from orders""",
)
def invoice_from_fields(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    number = F.when(k % 6 == 0, "").otherwise(F.format_string('"invoice_number":"INV-%d",', k))
    cur = F.when(k % 4 == 0, '"currency":"INR",').otherwise("")
    total = F.when(k % 10 == 0, "0").otherwise(F.floor("o_totalprice").cast("string"))
    js = F.concat(
        F.lit("```json\n{"), number, cur, F.format_string('"invoice_date":"%s","vendor_name":"Vendor %d","tax_amount":"n/a","total_amount":', F.date_format("o_orderdate", "yyyy-MM-dd"), c % 50),
        total, F.format_string(',"line_items":[{"description":"a","quantity":"%d","unit_price":"10"},{"description":"","quantity":"9"}]}\n```', c % 7),
    )
    return R.invoice_from_fields(t.orders.select("o_orderkey", js.alias("js")), "o_orderkey", "js")
