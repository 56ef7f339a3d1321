"""Registered queries for the knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from litmill.operators import fusion, graph, vectors
from litmill.plans import derived as dv
from litmill.plans.tables import dealt, table

def _entities(spark, d):
    """Suppliers, nations and regions as extracted entities: full forms with acronyms, bare acronyms, copies,
    numbers and blanks."""
    s, n, r = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "region")
    a = s.select(
        (F.col("s_suppkey") * 10).alias("pos"),
        F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.initcap("s_name"), F.lit(" Trading House (STH)")))
        .when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("QH"), F.col("s_suppkey").cast("string")))
        .when(F.col("s_suppkey") % 4 == 2, F.col("s_acctbal").cast("string"))
        .otherwise(F.upper("s_name")).alias("name"),
        F.when(F.col("s_acctbal") < 2000, "").otherwise("Organisation").alias("type"),
    )
    b = n.select((F.col("n_nationkey") * 10 + 1).alias("pos").cast("bigint"), F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("name"), F.lit("Country").alias("type"))
    c = r.select((F.col("r_regionkey") * 10 + 2).alias("pos").cast("bigint"), F.concat(F.lit("North "), F.substring("r_name", 1, 1), F.lower(F.col("r_name").substr(2, 50)), F.lit(" Economic Area")).alias("name"), F.lit("Area").alias("type"))
    e = r.select((F.col("r_regionkey") * 10 + 3).alias("pos").cast("bigint"), F.concat(F.lit("N"), F.substring("r_name", 1, 1), F.lit("EA")).alias("name"), F.lit("Area").alias("type"))
    return a.unionByName(b).unionByName(c).unionByName(e)


SQL_ENTITIES = """entities as (
  select s_suppkey * 10 as pos, case s_suppkey % 4 when 0 then upper(s_name[1]) || lower(s_name[2:]) || ' Trading House (STH)' when 1 then 'QH' || s_suppkey
      when 2 then s_acctbal::varchar else upper(s_name) end as name, case when s_acctbal < 2000 then '' else 'Organisation' end as type from supplier
  union all select n_nationkey * 10 + 1, ' ' || n_name || ' ', 'Country' from nation
  union all select r_regionkey * 10 + 2, 'North ' || upper(r_name[1]) || lower(r_name[2:]) || ' Economic Area', 'Area' from region
  union all select r_regionkey * 10 + 3, 'N' || r_name[1] || 'EA', 'Area' from region)"""


def _relations(spark, d):
    """Supplier in nation, nation in region (by acronym), with blanks and copies."""
    s, n, r = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "region")
    sn = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        (F.col("s_suppkey") * 2).alias("pos"),
        F.when(F.col("s_suppkey") % 10 == 0, "").otherwise(F.upper("s_name")).alias("head"), F.lit("").alias("head_type"),
        F.when(F.col("s_suppkey") % 3 == 0, F.lit(None)).otherwise(" located in ").alias("relation"),
        F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).otherwise(F.lower("n_name")).alias("tail"), F.lit("Country").alias("tail_type"), F.col("s_acctbal").cast("string").alias("evidence"),
    )
    nr = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        (F.col("s_suppkey") * 2 + 1).alias("pos"), F.col("n_name").alias("head"), F.lit("Country").alias("head_type"), F.lit("part of").alias("relation"),
        F.concat(F.lit("N"), F.substring("r_name", 1, 1), F.lit("EA")).alias("tail"), F.lit("").alias("tail_type"), F.lit(None).cast("string").alias("evidence"),
    )
    return sn.unionByName(nr)


SQL_RELATIONS = """relations as (
  select s_suppkey * 2 as pos, case when s_suppkey % 10 = 0 then '' else upper(s_name) end as head, '' as head_type, case when s_suppkey % 3 = 0 then null else ' located in ' end as relation,
    case when s_suppkey % 2 = 0 then n_name else lower(n_name) end as tail, 'Country' as tail_type, s_acctbal::varchar as evidence from supplier join nation on s_nationkey = n_nationkey
  union all
  select s_suppkey * 2 + 1, n_name, 'Country', 'part of', 'N' || r_name[1] || 'EA', '', null from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""

_INIT = "array_to_string(list_transform(list_filter(string_split_regex({x}, '[\\s\\-]+'), lambda w: w <> ''), lambda w: upper(w[1])), '')"


def sql_aliases(names: str, p: str) -> str:
    """CTE ``p``_alias (alias, canonical) over names(pos, name)."""
    after, before = r"^(.+?)\s*\(([A-Z][A-Z0-9\-]{1,12})\)\s*$", r"^([A-Z][A-Z0-9\-]{1,12})\s*\((.+?)\)\s*$"
    strip = dv.sql_strip
    return f"""{p}_par as (
    select pos, name, {strip(f"case when regexp_matches(name, '{after}') then regexp_extract(name, '{after}', 1) else regexp_extract(name, '{before}', 2) end")} as fl,
           {strip(f"case when regexp_matches(name, '{after}') then regexp_extract(name, '{after}', 2) else regexp_extract(name, '{before}', 1) end")} as sh
    from {names} where regexp_matches(name, '{after}') or regexp_matches(name, '{before}')),
  {p}_in as (select alias, arg_max(fl, pos) as canonical from (select pos, fl, unnest([lower(sh), lower(name)]) as alias from {p}_par where {_INIT.format(x='fl')} = upper(sh)) group by 1),
  {p}_full as (select {_INIT.format(x='name')} as ini, arg_min(name, pos) as canonical from {names} where len({dv.sql_words('name')}) >= 2 group by 1),
  {p}_pair as (select distinct name as acronym, canonical from {names} join {p}_full on ini = upper(name) where regexp_full_match(name, '[A-Z][A-Z0-9\\-]{{1,12}}')),
  {p}_alias as (select * from {p}_in union all select lower(acronym), min(canonical) from {p}_pair where lower(acronym) not in (select alias from {p}_in) group by 1)"""


_CLEAN = f"""clean as (select pos, {dv.sql_strip('name')} as name, {dv.sql_strip("case when type <> '' then type else 'Concept' end")} as type from entities
    where {dv.sql_strip('name')} <> '' and not regexp_matches({dv.sql_strip('name')}, '^\\d+(\\.\\d+)?$'))"""
_DEDUP = f"""dedup as (select pos, name, type from (select c.pos, coalesce(canonical, c.name) as name, type from clean c left join e_alias on alias = lower(c.name))
    qualify row_number() over (partition by lower(name), type order by pos) = 1)"""
_RELS = f"""rels as (select pos, coalesce(h.canonical, hd) as head, case when head_type <> '' then head_type else 'Concept' end as head_type, rel as relation, coalesce(t.canonical, tl) as tail,
      case when tail_type <> '' then tail_type else 'Concept' end as tail_type, evidence
    from (select *, {dv.sql_strip('head')} as hd, {dv.sql_strip('tail')} as tl, replace(upper({dv.sql_strip("coalesce(relation, 'RELATED_TO')")}), ' ', '_') as rel from relations)
    left join r_alias h on h.alias = lower(hd) left join r_alias t on t.alias = lower(tl)),
  crel as (select * from rels where head <> '' and tail <> '' qualify row_number() over (partition by lower(head), lower(tail), relation order by pos) = 1)"""
_CHAIN = f"with {SQL_ENTITIES}, {SQL_RELATIONS}, {_CLEAN}, {sql_aliases('clean', 'e')}, rawn as (select pos, name from entities where name <> ''), {sql_aliases('rawn', 'r')}, {_DEDUP}, {_RELS}"


def alias_map(spark, d):
    return graph.alias_map(graph._clean_entities(_entities(spark, d)).select("pos", "name"))


def acronym_pairs(spark, d):
    return graph.acronym_pairs(_entities(spark, d).select("pos", "name"))


def dedupe_entities(spark, d):
    return graph.dedupe_entities(_entities(spark, d))


def clean_relations(spark, d):
    e = _entities(spark, d).where("name <> ''").select("pos", "name")
    return graph.clean_relations(_relations(spark, d), graph.alias_map(e))


def _cleaned(spark, d):
    return graph.clean_graph(_entities(spark, d), _relations(spark, d))


def clean_graph(spark, d):
    e, r = _cleaned(spark, d)
    return e.select(F.lit("entity").alias("kind"), F.col("name").alias("a"), F.col("type").alias("b"), F.lit("").alias("c")).unionByName(
        r.select(F.lit("relation").alias("kind"), F.col("head").alias("a"), F.col("tail").alias("b"), F.col("relation").alias("c"))
    )


def build_graph(spark, d):
    nodes, edges = graph.build_graph(*_cleaned(spark, d))
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("type").alias("b"), F.lit("").alias("c")).unionByName(
        edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("type").alias("c"))
    )


def _supply_edges(spark, d):
    """Supplier and part of every line item; the return flag is the edge type."""
    li = table(spark, d, "lineitem")
    return li.select(F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("dst"),
                     F.concat(F.lit("SHIPPED_"), "l_returnflag").alias("type")).distinct()


def drop_isolated(spark, d):
    """Customers without an order go."""
    nodes = table(spark, d, "customer").select(F.concat(F.lit("CUSTOMER "), F.col("c_custkey").cast("string")).alias("id"), F.col("c_mktsegment").alias("type"))
    name = lambda kind, c: F.concat(F.lit(f"{kind} "), F.col(c).cast("string"))
    e = table(spark, d, "orders").select(name("Customer", "o_custkey").alias("src"), name("Order", "o_orderkey").alias("dst"), F.lit("PLACED").alias("type"))
    return graph.drop_isolated(nodes, e)


def khop_facts(spark, d):
    seeds = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("PPLIER "), F.col("s_suppkey").cast("string"), F.lit("")).alias("term"))
    return graph.khop_facts(_supply_edges(spark, d), seeds, 1, 60).select("query_id", "fact_no", "head", "rel", "tail", "text")


def khop_two(spark, d):
    """Two steps over suppliers, nations and regions."""
    _, edges = graph.build_graph(*_cleaned(spark, d))
    seeds = table(spark, d, "region").select(F.col("r_regionkey").alias("query_id"), F.concat(F.lit("north "), "r_name").alias("term"))
    return graph.khop_facts(edges, seeds, 2, 60).select("query_id", "fact_no", "head", "rel", "tail")


def _coded_edges(spark, d):
    """The same edges with one-word ids, as a question names them."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag").distinct()
    code = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"), F.lit("x"))
    return li.select(code("sup", "l_suppkey").alias("src"), code("part", "l_partkey").alias("dst"), F.concat(F.lit("SHIPPED_"), "l_returnflag").alias("type"))


def _graph_found(spark, d, tail):
    docs = dealt(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("sup"), F.col("item_id").cast("string"), F.lit("x"), tail).alias("query"))
    v = vectors.hash_embed(docs).select("chunk_id", "embedding")
    return graph.graph_retrieve(vectors.hash_embed(q, text="query"), docs, v, _coded_edges(spark, d))


def graph_retrieve(spark, d):
    out = _graph_found(spark, d, F.concat(F.lit(" and "), F.col("text")))
    return out.select("query_id", "id", "source_type", F.round("score", 6).alias("score"), "rank")


def graph_context(spark, d):
    return fusion.build_context(_graph_found(spark, d, F.lit("")), 400)


QUERIES = {
    "joi6_drop_isolated": drop_isolated,
    "joi8_acronym_pairs": acronym_pairs,
    "kgr1_alias_map": alias_map,
    "kgr2_dedupe_entities": dedupe_entities,
    "kgr3_clean_relations": clean_relations,
    "kgr4_clean_graph": clean_graph,
    "kgr5_build_graph": build_graph,
    "kgr6_khop_facts": khop_facts,
    "kgr6_khop_two": khop_two,
    "kgr7_graph_retrieve": graph_retrieve,
    "kgr7_graph_context": graph_context,
}

_EDGES = "e as (select distinct 'Supplier ' || l_suppkey as src, 'Part ' || l_partkey as dst, 'SHIPPED_' || l_returnflag as type from lineitem)"
_GRAPH = f"""{_CHAIN},
  ge as (select pos, {dv.sql_squeeze('name')} as name, type from dedup), {sql_aliases('ge', 'g')},
  gr as (select pos, coalesce(h.canonical, c.head) as head, head_type, relation, coalesce(t.canonical, c.tail) as tail, tail_type from crel c
    left join g_alias h on h.alias = lower(c.head) left join g_alias t on t.alias = lower(c.tail)),
  okr as (select * from gr where length(head) > 1 and length(tail) > 1 and not regexp_matches(head, '^\\d+(\\.\\d+)?$') and not regexp_matches(tail, '^\\d+(\\.\\d+)?$')),
  ent as (select coalesce(canonical, name) as id, type, (0, pos, 0) as wh from ge left join g_alias on alias = lower(name) union all select head, head_type, (1, pos, 0) from okr union all select tail, tail_type, (1, pos, 1) from okr),
  nd as (select lower(id) as key, arg_min(id, wh) as id, arg_min(type, wh) as type from ent where length(id) > 1 and not regexp_matches(id, '^\\d+(\\.\\d+)?$') group by 1),
  ed as (select a.id as src, b.id as dst, relation as type from okr join nd a on a.key = lower(head) join nd b on b.key = lower(tail))"""

ORACLES = {
    "joi6_drop_isolated": "select 'CUSTOMER ' || c_custkey as id, c_mktsegment as type from customer where c_custkey in (select o_custkey from orders)",
    "joi8_acronym_pairs": f"with {SQL_ENTITIES}, {sql_aliases('entities', 'x')} select acronym, canonical from x_pair",
    "kgr1_alias_map": f"{_CHAIN} select * from e_alias",
    "kgr2_dedupe_entities": f"{_CHAIN} select pos, name, type from dedup",
    "kgr3_clean_relations": f"{_CHAIN} select pos, head, head_type, relation, tail, tail_type, evidence from crel",
    "kgr4_clean_graph": f"{_CHAIN} select 'entity' as kind, name as a, type as b, '' as c from dedup union all select 'relation', head, tail, relation from crel",
    "kgr5_build_graph": f"{_GRAPH} select 'node' as kind, id as a, type as b, '' as c from nd union all select 'edge', src, dst, type from ed",
    "kgr6_khop_facts": f"""with {_EDGES}, m as (select s_suppkey as query_id, src, dst, type from supplier join e on contains(lower(src), 'pplier ' || s_suppkey)),
      r as (select *, row_number() over (partition by query_id order by src, type, dst) as n from (select distinct * from m))
      select query_id, (n - 1)::int as fact_no, src as head, type as rel, dst as tail, src || ' ' || lower(replace(type, '_', ' ')) || ' ' || dst as text from r where n <= 60""",
    "kgr6_khop_two": f"""{_GRAPH}, de as (select distinct * from ed), s as (select r_regionkey as query_id, key, id from region join nd on contains(key, 'north ' || lower(r_name))),
      f as (select query_id, id, 0 as step from s union select query_id, case when d.src = s.id then d.dst else d.src end, 1 from s join de d on s.id in (d.src, d.dst)),
      t as (select query_id, src, dst, type, min(step) as step from f join de on f.id in (src, dst) group by all),
      r as (select *, row_number() over (partition by query_id order by step, src, type, dst) as n from t)
      select query_id, (n - 1)::int as fact_no, src as head, type as rel, dst as tail from r where n <= 60""",
}
