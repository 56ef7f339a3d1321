"""Knowledge graph: aliases, clean-up of extracted entities and relations, nodes and edges, k-hop facts.

Everything is joins and aggregates on names; "the first one wins" is a minimum over positions, so hot
names are reduced before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions.skew import first_rows, spread, top_k
from litmill.functions.text import squeeze, strip
from litmill.operators import fusion
from litmill.operators.queries import seed_terms
from litmill.operators.vectors import knn
from litmill.session import cut_lineage
from litmill.sources.model_output import relation_type

_ACRONYM = r"[A-Z][A-Z0-9\-]{1,12}"
_NUMBER = r"^\d+(\.\d+)?$"
GRAM = 8
HUB = 50_000


def initials_of(c: Column) -> Column:
    """Upper-case first letters of the words of a name, hyphens counting as blanks."""
    parts = F.filter(F.split(c, r"[\s\-]+", -1), lambda w: w != "")
    return F.array_join(F.transform(parts, lambda w: F.upper(F.substring(w, 1, 1))), "")


def _parenthetical(names: DataFrame) -> DataFrame:
    """(alias, canonical, pos) from "Full Form (FF)" and "FF (Full Form)" when the initials agree."""
    after, before = rf"^(.+?)\s*\(({_ACRONYM})\)\s*$", rf"^({_ACRONYM})\s*\((.+?)\)\s*$"
    n = F.col("name")
    pick = lambda p, g: strip(F.regexp_extract(n, p, g))
    is_after = n.rlike(after)
    full = F.when(is_after, pick(after, 1)).otherwise(pick(before, 2))
    short = F.when(is_after, pick(after, 2)).otherwise(pick(before, 1))
    rows = names.where(is_after | n.rlike(before)).select("pos", "name", full.alias("full"), short.alias("short"))
    rows = rows.where((F.length("short") >= 2) & (initials_of(F.col("full")) == F.upper("short")))
    aliases = F.array(F.lower("short"), F.lower("name"))
    return rows.select(F.explode(aliases).alias("alias"), F.col("full").alias("canonical"), "pos")


def acronym_pairs(names: DataFrame) -> DataFrame:
    """(acronym, canonical): an all-capitals name and the first name of several words with these initials.

    names: pos, name. An equi join on computed initials; every initials string keeps one full form.
    """
    words = F.size(F.filter(F.split(strip(F.col("name")), r"\s+"), lambda w: w != ""))
    full = names.where(words >= 2).groupBy(initials_of(F.col("name")).alias("initials")).agg(F.min_by("name", "pos").alias("canonical"))
    short = names.where(F.col("name").rlike(rf"^{_ACRONYM}$")).select(F.col("name").alias("acronym")).distinct()
    return short.join(full, F.upper("acronym") == F.col("initials")).select("acronym", "canonical")


def alias_map(names: DataFrame) -> DataFrame:
    """(alias, canonical), one row per lower-case alias. names: pos, name.

    Forms in parentheses come first (the last one of an alias wins, as later entries replace earlier ones);
    other acronyms are paired by initials.
    """
    inline = _parenthetical(names).groupBy("alias").agg(F.max_by("canonical", "pos").alias("canonical"))
    paired = acronym_pairs(names).select(F.lower("acronym").alias("alias"), "canonical")
    return inline.unionByName(paired.groupBy("alias").agg(F.min("canonical").alias("canonical")).join(inline.select("alias"), "alias", "left_anti"))


def _resolved(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Replace names that have an alias entry by their canonical form."""
    a = aliases.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
    out = df.join(a, F.lower(column) == F.col("_alias"), "left")
    return out.withColumn(column, F.coalesce("_canonical", F.col(column))).drop("_alias", "_canonical")


def _clean_entities(entities: DataFrame) -> DataFrame:
    typed = F.when(F.coalesce("type", F.lit("")) != "", F.col("type")).otherwise("Concept")
    clean = entities.select("pos", strip(F.coalesce("name", F.lit(""))).alias("name"), strip(typed).alias("type"))
    return clean.where((F.col("name") != "") & ~F.col("name").rlike(_NUMBER))


def dedupe_entities(entities: DataFrame) -> DataFrame:
    """(pos, name, type): canonical names, one per (lower-case name, type); empty and numeric names dropped."""
    clean = _clean_entities(entities)
    named = _resolved(clean, "name", alias_map(clean.select("pos", "name")))
    return first_rows(named.withColumn("_k", F.lower("name")), ["_k", "type"], ["pos"]).select("pos", "name", "type")


def clean_relations(relations: DataFrame, aliases: DataFrame) -> DataFrame:
    """(pos, head, head_type, relation, tail, tail_type, evidence): endpoints resolved, types normalised, one per
    (head, tail, type) in any case; rows without an endpoint dropped."""
    text = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    typed = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise("Concept")
    rows = relations.select(
        "pos", text("head").alias("head"), typed("head_type").alias("head_type"), relation_type(F.col("relation")).alias("relation"),
        text("tail").alias("tail"), typed("tail_type").alias("tail_type"), "evidence",
    )
    rows = _resolved(_resolved(rows, "head", aliases), "tail", aliases).where("head != '' and tail != ''")
    keyed = rows.withColumn("_h", F.lower("head")).withColumn("_t", F.lower("tail"))
    return first_rows(keyed, ["_h", "_t", "relation"], ["pos"]).select("pos", "head", "head_type", "relation", "tail", "tail_type", "evidence")


def clean_graph(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities merged by alias and relations re-pointed to the merged names.

    Both results are checkpointed: the steps after this one read them several times.
    """
    named = entities.where(F.coalesce("name", F.lit("")) != "").select("pos", "name")
    aliases = cut_lineage(alias_map(named))
    return cut_lineage(dedupe_entities(entities)), cut_lineage(clean_relations(relations, aliases))


def _is_node(c: Column) -> Column:
    return ~c.rlike(_NUMBER) & (F.length(c) > 1)


def build_graph(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, type) and edges (src, dst, type) with every endpoint a node.

    Names are resolved by alias; empty, numeric and one-character ids are dropped; the first entry of an
    id (entities before relations, heads before tails) decides its spelling and type.
    """
    flat = lambda c: squeeze(F.coalesce(F.col(c), F.lit("")))
    typed = lambda c: F.when(flat(c) != "", flat(c)).otherwise("Concept")
    names = entities.select("pos", flat("name").alias("name"))
    aliases = cut_lineage(alias_map(names.where("name != ''")))
    ents = _resolved(entities.select("pos", flat("name").alias("id"), typed("type").alias("type")), "id", aliases)
    rels = relations.select(
        "pos", flat("head").alias("head"), typed("head_type").alias("head_type"), flat("relation").alias("relation"),
        flat("tail").alias("tail"), typed("tail_type").alias("tail_type"),
    )
    rels = _resolved(_resolved(rels, "head", aliases), "tail", aliases).where(_is_node(F.col("head")) & _is_node(F.col("tail")))
    rels = cut_lineage(rels)
    at = lambda src, side: F.struct(F.lit(src).alias("src"), "pos", F.lit(side).alias("side"))
    entries = (
        ents.where(_is_node(F.col("id"))).select("id", "type", at(0, 0).alias("at"))
        .unionByName(rels.select(F.col("head").alias("id"), F.col("head_type").alias("type"), at(1, 0).alias("at")))
        .unionByName(rels.select(F.col("tail").alias("id"), F.col("tail_type").alias("type"), at(1, 1).alias("at")))
    )
    nodes = entries.groupBy(F.lower("id").alias("key")).agg(F.min_by(F.struct("id", "type"), "at").alias("n")).select("key", "n.id", "n.type")
    nodes = cut_lineage(nodes)
    ids = nodes.select("key", "id")
    rel = F.when(F.col("relation") != "", F.replace(F.upper("relation"), F.lit(" "), F.lit("_"))).otherwise("RELATED_TO")
    edges = (
        rels.select(F.lower("head").alias("hk"), F.lower("tail").alias("tk"), rel.alias("type"))
        .join(ids.select(F.col("key").alias("hk"), F.col("id").alias("src")), "hk")
        .join(ids.select(F.col("key").alias("tk"), F.col("id").alias("dst")), "tk")
        .select("src", "dst", "type")
    )
    return nodes.select("id", "type"), edges


def drop_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with an edge, any case. Endpoints are made distinct first, so hubs cost one row."""
    ends = edges.select(F.explode(F.array(F.lower("src"), F.lower("dst"))).alias("_k")).distinct()
    return nodes.join(ends, F.lower("id") == F.col("_k"), "left_semi")


# ---- facts around seed terms ------------------------------------------------------------------------------


def _numbered(seeds: DataFrame, key: str) -> DataFrame:
    """(key, block, bit): a place for each question in masks of 64 bits."""
    no = F.monotonically_increasing_id()
    rows = seeds.select(key).distinct().withColumn("_no", no)
    return cut_lineage(rows.select(key, F.floor(F.col("_no") / 64).alias("block"), (F.col("_no") % 64).cast("int").alias("bit")))


def _masked(rows: DataFrame, numbers: DataFrame, key: str, *group: str) -> DataFrame:
    """(group, block, mask): the questions of each group of ``rows`` as bits."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    return rows.join(numbers, key).groupBy(*group, "block").agg(F.bit_or(bit).alias("mask"))


def _bits(mask: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", mask, i) == 1)


def _seed_nodes(nodes: DataFrame, seeds: DataFrame, numbers: DataFrame, key: str) -> DataFrame:
    """(id, block, mask): nodes whose id contains a seed term, any case, with the questions of these terms.

    A term meets an id on a piece of the id as long as the term: up to GRAM characters, of longer terms the first GRAM, which
    are then looked at whole. Only pieces of lengths that some term has are made, and distinct terms and ids are compared.
    """
    terms = seeds.select(key, F.lower(strip(F.col("term"))).alias("term")).where("term != ''").distinct()
    asked = cut_lineage(_masked(terms, numbers, key, "term"))
    n = F.least(F.length("term"), F.lit(GRAM))
    lengths = asked.agg(F.sort_array(F.collect_set(n)).alias("l")).first().l  # at most GRAM numbers
    low = F.lower("id")

    def pieces_of(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(low) - (size - 1))
        return F.when(F.length(low) >= size, F.transform(starts, lambda i: F.substring(low, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    pieces = [pieces_of(size) for size in lengths]
    grams = F.array_distinct(F.concat(*pieces)) if pieces else F.array().cast("array<string>")
    by_gram = nodes.where(F.length("id") > 0).select("id", low.alias("low"), F.explode(grams).alias("gram"))
    distinct = asked.select("term", F.substring("term", 1, GRAM).alias("gram")).distinct()
    hits = distinct.join(by_gram, "gram").where((F.length("term") <= GRAM) | F.contains("low", F.col("term"))).select("term", "id")
    return hits.join(asked, "term").groupBy("id", "block").agg(F.bit_or("mask").alias("mask"))


def _without(rows: DataFrame, taken: str) -> DataFrame:
    """(id, block, mask) without the questions in the mask ``taken``."""
    left = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce(taken, F.lit(0))))
    return rows.select("id", "block", left.alias("mask")).where("mask != 0")


def sharded_ends(edges: DataFrame, hub: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(ends, hubs). ``ends``: (a, shard, b, type, out), every edge at both its ends, ``out`` where a is its source. ``hubs``: (a,
    shards) of the nodes with more than ``hub`` (HUB) ends, which are dealt to shards of about that many; others have shard 0 alone."""
    hub = hub or HUB
    e = edges.where("src is not null and dst is not null").select("src", "type", "dst").distinct()
    at = lambda a, b, out: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(out).alias("out"))
    sides = F.when(F.col("src") == F.col("dst"), F.array(at("src", "dst", True))).otherwise(F.array(at("src", "dst", True), at("dst", "src", False)))
    both = cut_lineage(e.select("type", F.explode(sides).alias("s")).select("s.a", "s.b", "type", "s.out"))
    hubs = both.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > hub)
    hubs = cut_lineage(hubs.select("a", F.ceil(F.col("n") / hub).cast("int").alias("shards")))
    shard = F.coalesce(F.pmod(F.xxhash64("b", "type"), F.col("shards")), F.lit(0)).cast("int").alias("shard")
    return both.join(hubs, "a", "left").select("a", shard, "b", "type", "out"), hubs


def _touched(front: DataFrame, ends: DataFrame, hubs: DataFrame) -> DataFrame:
    """(a, b, type, out, block, mask): the edges at the nodes of ``front``; a hub's questions go to each of its shards."""
    spread = front.join(hubs.withColumnRenamed("a", "id"), "id", "left")
    spread = spread.select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.coalesce("shards", F.lit(1)) - 1)).alias("shard"), "block", "mask")
    return spread.join(ends, ["a", "shard"]).drop("shard")


def _nearest_ends(front: DataFrame, ends: DataFrame, n: int) -> DataFrame:
    """The first ``n`` ends of each shard of the nodes of ``front``, by names: what a question can take of them.

    The tasks are as many as the ends, and the pairs of question and end that they become, need.
    """
    asked = front.agg(F.coalesce(F.sum(F.bit_count("mask")), F.lit(0))).first()[0]
    at = ends.join(front.select(F.col("id").alias("a")).distinct(), "a", "left_semi")
    src, dst = F.when(F.col("out"), F.col("a")).otherwise(F.col("b")), F.when(F.col("out"), F.col("b")).otherwise(F.col("a"))
    return top_k(spread(at, ["a", "shard"], max(ends.count(), asked * n)), ["a", "shard"], [src, F.col("type"), dst], n, "n").drop("n")


def khop_facts(edges: DataFrame, seeds: DataFrame, hops: int = 2, limit: int = 60, key: str = "query_id", hub: int | None = None) -> DataFrame:
    """(key, fact_no, head, rel, tail, text): edges on a path of up to ``hops`` steps, in any direction, from a node
    that contains a seed term; nearest first, then by name, at most ``limit`` per question.

    A node is at the smallest number of steps it is reached in; an edge belongs to the answer when one end
    is less than ``hops`` steps away. A step's front has one row for each node and 64 questions, who are bits of a mask; a hub's
    edges are dealt to shards. Nearer facts come first, so a question that has ``limit`` of them goes no further.
    """
    ends, hubs = sharded_ends(edges, hub)
    numbers = _numbered(seeds, key)
    nodes = ends.select(F.col("a").alias("id")).distinct()
    front = cut_lineage(_seed_nodes(nodes, seeds, numbers, key))
    reached, found = front, None
    order = [F.col("src"), F.col("type"), F.col("dst")]
    for step in range(hops):
        # a question meets an edge at one end or both, so the first 2 x limit rows, of a node and of all, hold the first ``limit`` edges
        touched = _touched(front, _nearest_ends(front, ends, 2 * limit), hubs)
        src, dst = F.when(F.col("out"), F.col("a")).otherwise(F.col("b")), F.when(F.col("out"), F.col("b")).otherwise(F.col("a"))
        each = touched.select(src.alias("src"), "type", dst.alias("dst"), "block", F.explode(_bits(F.col("mask"))).alias("bit"))
        nearest = top_k(each, ["block", "bit"], order, 2 * limit, "n").drop("n").join(numbers, ["block", "bit"])
        nearest = nearest.select(key, "src", "type", "dst", F.lit(step).alias("step"))
        found = nearest if found is None else found.unionByName(nearest)
        if step + 1 < hops:
            found = cut_lineage(found)
            full = found.groupBy(key).agg(F.count_distinct("src", "type", "dst").alias("n")).where(F.col("n") >= limit)
            full = _masked(full, numbers, key).withColumnRenamed("mask", "_full")
            walking = _without(front.join(full, "block", "left"), "_full")
            nxt = _touched(walking, ends, hubs).groupBy(F.col("b").alias("id"), "block").agg(F.bit_or("mask").alias("mask"))
            old = reached.groupBy("id", "block").agg(F.bit_or("mask").alias("_old"))
            front = cut_lineage(_without(nxt.join(old, ["id", "block"], "left"), "_old"))
            reached = reached.unionByName(front)
    facts = found.groupBy(key, "src", "type", "dst").agg(F.min("step").alias("step"))
    best = top_k(facts, [key], [F.col("step"), *order], limit, "n")
    text = F.concat_ws(" ", "src", F.lower(F.replace("type", F.lit("_"), F.lit(" "))), "dst")
    return best.select(key, (F.col("n") - 1).alias("fact_no"), F.col("src").alias("head"), F.col("type").alias("rel"), F.col("dst").alias("tail"), text.alias("text"))


def graph_retrieve(
    queries: DataFrame, chunks: DataFrame, vectors: DataFrame, edges: DataFrame, k_chunks: int = 10, hops: int = 2, facts: int = 60, k: int = 6
) -> DataFrame:
    """(query_id, id, text, source_type, score, rank): nearest chunks and k-hop facts of each question, reranked together.

    queries: query_id, query, embedding; chunks: chunk_id, text; vectors: chunk_id, embedding.
    """
    near = knn(queries, vectors, k_chunks).join(chunks.select("chunk_id", "text"), "chunk_id")
    known = khop_facts(edges, seed_terms(queries), hops, facts)
    return fusion.rerank_ngrams(queries, fusion.all_contexts(near, known), k)
