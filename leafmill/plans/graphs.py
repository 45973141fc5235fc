"""Registered graph queries: G1-G7, M2, A14, A33."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import patterns as P
from leafmill.operators import graph as G
from leafmill.plans.sqlparts import quote
from leafmill.registry import query
from leafmill.sources.tables import Tables

GRAPH = """v as (select 'C' || c_custkey as id, c_name as name, 'Person' as type from customer union all select 'S' || s_suppkey, s_name, 'Organization' from supplier
  union all select 'N' || n_nationkey, n_name, 'Location' from nation union all select 'R' || r_regionkey, r_name, 'Location' from region
  union all select 'O' || o_orderkey, 'Order ' || o_orderkey, 'Contract' from orders),
e as (select 'C' || c_custkey as src, 'LOCATED_IN' as type, 'N' || c_nationkey as dst from customer union all select 'S' || s_suppkey, 'LOCATED_IN', 'N' || s_nationkey from supplier
  union all select 'N' || n_nationkey, 'PART_OF', 'R' || n_regionkey from nation union all select 'O' || o_orderkey, 'SIGNED_BY', 'C' || o_custkey from orders
  union all select distinct 'O' || l_orderkey, 'INVOLVES', 'S' || l_suppkey from lineitem)"""


def _id(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.col(col))


def vertices(t: Tables) -> DataFrame:
    def part(df, prefix, key, name, kind):
        return df.select(_id(prefix, key).alias("id"), name.alias("name"), F.lit(kind).alias("type"))

    return (
        part(t.customer, "C", "c_custkey", F.col("c_name"), "Person")
        .unionByName(part(t.supplier, "S", "s_suppkey", F.col("s_name"), "Organization"))
        .unionByName(part(t.nation, "N", "n_nationkey", F.col("n_name"), "Location"))
        .unionByName(part(t.region, "R", "r_regionkey", F.col("r_name"), "Location"))
        .unionByName(part(t.orders, "O", "o_orderkey", F.concat(F.lit("Order "), "o_orderkey"), "Contract"))
    )


def edges(t: Tables, repeats: bool = False) -> DataFrame:
    """``(src, type, dst)``; with ``repeats`` an order's supplier comes once for each of its lines."""

    def part(df, src, kind, dst):
        return df.select(src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst"))

    involved = t.lineitem.select("l_orderkey", "l_suppkey")
    involved = involved if repeats else involved.distinct()
    return (
        part(t.customer, _id("C", "c_custkey"), "LOCATED_IN", _id("N", "c_nationkey"))
        .unionByName(part(t.supplier, _id("S", "s_suppkey"), "LOCATED_IN", _id("N", "s_nationkey")))
        .unionByName(part(t.nation, _id("N", "n_nationkey"), "PART_OF", _id("R", "n_regionkey")))
        .unionByName(part(t.orders, _id("O", "o_orderkey"), "SIGNED_BY", _id("C", "o_custkey")))
        .unionByName(part(involved, _id("O", "l_orderkey"), "INVOLVES", _id("S", "l_suppkey")))
    )


@query(
    "entity_id",
    "G1",
    r"""select p_partkey, substr(sha256('ws' || (p_partkey % 3) || '::' || lower(p_type) || '::' || regexp_replace(regexp_replace(lower(trim(p_name || ' & Co.')), '[^a-z0-9_\-\s]', '', 'g'), '\s+', '_', 'g')), 1, 16) as id from part""",
)
def entity_id(t: Tables) -> DataFrame:
    ws = F.concat(F.lit("ws"), F.col("p_partkey") % 3)
    return t.part.select("p_partkey", G.entity_id(ws, F.col("p_type"), F.concat("p_name", F.lit(" & Co."))).alias("id"))


_RAW = """en as (select l_orderkey as chunk, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey as ord, case when l_partkey % 13 = 0 then ' ' else ' ' || p_name end as name, p_type as type from lineitem join part on p_partkey = l_partkey),
rl as (select l_orderkey as chunk, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey as ord, p_name as src, case when l_partkey % 2 = 0 then p_name else 'nowhere' end as dst, 'INVOLVES' as type from lineitem join part on p_partkey = l_partkey)"""


@query(
    "entity_clean",
    "G2",
    f"""with {_RAW}, n as (select chunk, trim(name) as name, arg_max(type, ord) as type from en where trim(name) <> '' group by 1, 2),
r as (select rl.chunk, count(*) as n from rl where (chunk, src) in (select (chunk, name) from n) and (chunk, dst) in (select (chunk, name) from n) group by 1)
select n.chunk, count(*) as n_entities, max(n.name || ':' || n.type) as last_entity, coalesce(any_value(r.n), 0) as n_relations from n left join r on r.chunk = n.chunk group by 1""",
)
def entity_clean(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    ord_ = F.col("l_linenumber").cast("bigint") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    name = F.when(F.col("l_partkey") % 13 == 0, " ").otherwise(F.concat(F.lit(" "), "p_name"))
    base = j.select(F.col("l_orderkey").alias("chunk"), ord_.alias("ord"), name.alias("name"), F.col("p_type").alias("type"))
    rel = j.select(
        F.col("l_orderkey").alias("chunk"), ord_.alias("ord"), F.col("p_name").alias("src"),
        F.when(F.col("l_partkey") % 2 == 0, F.col("p_name")).otherwise("nowhere").alias("dst"), F.lit("INVOLVES").alias("type"),
    )
    ents, rels = G.entity_clean(base, rel)
    n = ents.groupBy("chunk").agg(F.count("*").alias("n_entities"), F.max(F.concat_ws(":", "name", "type")).alias("last_entity"))
    return n.join(rels.groupBy("chunk").agg(F.count("*").alias("n_relations")), "chunk", "left").na.fill(0)


@query(
    "merge_entities",
    "M2",
    """select p_name as id, arg_max(p_brand, p_partkey) as name, arg_max(p_size, p_partkey) filter (p_size > 10) as size from part group by 1""",
)
def merge_entities(t: Tables) -> DataFrame:
    rows = t.part.select(
        F.col("p_name").alias("id"), F.col("p_brand").alias("name"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("size"), F.col("p_partkey").alias("v")
    )
    return G.merge_entities(rows, ["name", "size"], "v")


@query(
    "merge_relationships",
    "M2",
    f"""with {GRAPH}, r as (select 'O' || l_orderkey as src, 'INVOLVES' as type, 'S' || l_suppkey as dst, l_quantity as weight, (l_partkey * 10 + l_linenumber) * 1000 + l_quantity::bigint as v from lineitem)
select src, type, dst, arg_max(weight, v) as weight from r where src in (select id from v) and dst in (select id from v where id <> 'S7') group by 1, 2, 3""",
)
def merge_relationships(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        _id("O", "l_orderkey").alias("src"), F.lit("involves!").alias("type"), _id("S", "l_suppkey").alias("dst"),
        F.col("l_quantity").alias("weight"), ((F.col("l_partkey") * 10 + F.col("l_linenumber")) * 1000 + F.col("l_quantity").cast("bigint")).alias("v"),
    )
    return G.merge_relationships(rows, vertices(t).where("id <> 'S7'"), ["weight"], "v")


@query(
    "entity_search",
    "G3",
    f"""with {GRAPH}, h as (select * from v where contains(lower(name), '00') order by id limit 20)
select distinct h.id, h.name, h.type, e.type as rel, w.name as target, w.type as target_type from h left join (e join v w on w.id = e.dst) on e.src = h.id""",
)
def entity_search(t: Tables) -> DataFrame:
    return G.entity_search(vertices(t), edges(t), "00")


@query(
    "document_entities",
    "G4",
    """select p_partkey as id, p_name as name, p_brand as type from part where p_partkey in (select l_partkey from lineitem where l_suppkey = 3) order by type, name, id limit 50""",
)
def document_entities(t: Tables) -> DataFrame:
    v = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"))
    e = t.lineitem.select(F.col("l_partkey").alias("src"), F.lit("EXTRACTED_FROM").alias("type"), F.concat(F.lit("doc"), "l_suppkey").alias("dst"))
    return G.document_entities(v, e, "doc3")


@query(
    "neighbourhood",
    "G5",
    f"""with {GRAPH} select e.src, v.name as entity, e.type as relationship, e.dst, w.name as connected_to, w.type as connected_type from v join e on e.src = v.id join v w on w.id = e.dst
 where contains(lower(v.name), 'order 1') order by e.src, e.type, e.dst limit 30""",
)
def neighbourhood(t: Tables) -> DataFrame:
    return G.neighbourhood(vertices(t), edges(t), "ORDER 1").select("src", "entity", "relationship", "dst", "connected_to", "connected_type")


@query(
    "paths",
    "G6",
    f"""with {GRAPH}, p1 as (select src as start, dst as "end", 1 as hops, src || '>' || dst as path, type as rels from e where src like 'O%'),
p2 as (select p1.start, e.dst as "end", 2 as hops, path || '>' || e.dst as path, rels || '>' || type as rels from p1 join e on e.src = p1.end),
p3 as (select p2.start, e.dst as "end", 3 as hops, path || '>' || e.dst as path, rels || '>' || type as rels from p2 join e on e.src = p2.end),
a as (select * from p1 union all select * from p2 union all select * from p3)
select start, "end", hops::int as hops, path, rels from (select *, row_number() over (partition by start, "end" order by hops, path) as rn from a where "end" like 'R%') where rn <= 5""",
)
def paths(t: Tables) -> DataFrame:
    v = vertices(t)
    return G.paths(edges(t), v.where("id like 'O%'"), v.where("id like 'R%'"), 3, per_pair=5)


@query(
    "type_normalise",
    "G7",
    f"""select p_partkey, case when trim(initcap) in ({', '.join(quote(x) for x in P.ENTITY_TYPES)}) then trim(initcap) else '__Entity__' end as entity_type,
 case when regexp_replace(upper(rel), '[^A-Z_]', '', 'g') in ({', '.join(quote(x) for x in P.RELATION_TYPES)}) then regexp_replace(upper(rel), '[^A-Z_]', '', 'g') else 'RELATED_TO' end as relation_type
 from (select p_partkey, [' Person ', 'Widget', 'Contract'][(p_partkey % 3 + 1)::int] as initcap, ['signed_by 2', 'part of', 'MENTIONS'][(p_partkey % 3 + 1)::int] as rel from part)""",
)
def type_normalise(t: Tables) -> DataFrame:
    i = (F.col("p_partkey") % 3 + 1).cast("int")
    kind = F.element_at(F.array(F.lit(" Person "), F.lit("Widget"), F.lit("Contract")), i)
    rel = F.element_at(F.array(F.lit("signed_by 2"), F.lit("part of"), F.lit("MENTIONS")), i)
    return t.part.select("p_partkey", G.entity_type(kind).alias("entity_type"), G.relation_type(rel).alias("relation_type"))


@query("schema_summary", "A14", f"with {GRAPH} select label, count(*) as n from (select unnest(['__Entity__', type]) as label from v) group by 1")
def schema_summary(t: Tables) -> DataFrame:
    return G.schema_summary(vertices(t).select(F.array(F.lit("__Entity__"), F.col("type")).alias("labels")))


@query(
    "visual_graph",
    "A33",
    f"""with {GRAPH}, c as (select v.name as src, e.type as rel, w.name as dst, v.type as st, w.type as dt from v join e on e.src = v.id join v w on w.id = e.dst),
n as (select name, min(type) as type from (select src as name, st as type from c union all select dst, dt from c) group by 1)
select 'node' as kind, name as a, type as b, '' as c from n union all select distinct 'edge', src, rel, dst from c""",
)
def visual_graph(t: Tables) -> DataFrame:
    v, e = vertices(t), edges(t, repeats=True).withColumnRenamed("type", "rel")
    tasks = G.tasks_for(t.spark, v.count() + e.count())
    to = v.select(F.col("id").alias("dst"), F.col("name").alias("target"), F.col("type").alias("target_type"))
    aimed = e.repartition(tasks, "dst").join(to.repartition(tasks, "dst"), "dst")
    rec = aimed.repartition(tasks, "src").join(v.repartition(tasks, "id"), F.col("src") == F.col("id"))
    records = rec.select(F.col("name").alias("entity"), "type", F.array(F.struct("rel", "target", "target_type")).alias("connections"))
    nodes, links = G.visual_graph(records)
    return nodes.select(F.lit("node").alias("kind"), F.col("name").alias("a"), F.col("type").alias("b"), F.lit("").alias("c")).unionByName(
        links.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("rel").alias("b"), F.col("dst").alias("c"))
    )
