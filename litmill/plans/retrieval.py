"""Registered queries for lexical and dense search, fusion, reranking and context building."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from litmill.functions import fixed_values as fv
from litmill.operators import cells, fusion, lexical, queries, vectors
from litmill.plans import derived as dv
from litmill.plans.tables import dealt, table
from litmill.session import ensure_checkpoint_dir


def _corpus(spark, d):
    return dealt(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))


def _asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _out(df, *columns):
    return df.select(*columns, "rank", F.round("score", 6).alias("score"))


def hash_embed(spark, d):
    e = vectors.hash_embed(table(spark, d, "documents").select("doc_id", "text"))
    at = lambda i: F.round(F.col("embedding")[i], 6)
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return e.select("doc_id", F.size("embedding").alias("dims"), at(0).alias("v0"), at(31).alias("v31"), at(63).alias("v63"), F.round(weighted, 6).alias("weighted"))


def _vector_questions(spark, d):
    """Every vector asks for its neighbours."""
    return dv.vectors(spark, d).select(F.col("chunk_id").alias("query_id"), "embedding")


def knn(spark, d):
    return _out(vectors.knn(_vector_questions(spark, d), dv.vectors(spark, d), 10), "query_id", "chunk_id")


def knn_blocks(spark, d):
    """The same search with smaller blocks."""
    found = vectors.knn(_vector_questions(spark, d), dv.vectors(spark, d), 10, question_mb=0.05, vector_mb=0.1)
    return _out(found, "query_id", "chunk_id")


def knn_where(spark, d):
    return _out(vectors.knn(_vector_questions(spark, d), dv.vectors(spark, d), 5, where=F.col("label") == 3), "query_id", "chunk_id")


def _vector_store(spark, d):
    """The vectors in cells, stored in two appends; their type is the label."""
    v = dv.vectors(spark, d).select("chunk_id", "embedding", F.col("label").cast("string").alias("chunk_type"))
    store = cells.VectorStore(spark, f"{ensure_checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}")
    return store.append(v.where("chunk_type <> '1'")).append(v.where("chunk_type = '1'"))


def knn_cells(spark, d):
    return _out(vectors.knn(_vector_questions(spark, d), _vector_store(spark, d), 10), "query_id", "chunk_id")


def knn_cells_typed(spark, d):
    q = _vector_questions(spark, d).withColumn("want", F.lit("3"))
    return _out(vectors.knn(q, _vector_store(spark, d), 5), "query_id", "chunk_id")


def upsert_vectors(spark, d):
    v = dv.vectors(spark, d)
    new = vectors.upsert_vectors(v.where("label <> 1"), v.unionByName(v.where("label = 1")))
    return new.select("chunk_id", "label")


def tokens(spark, d):
    t = lexical.tokens(table(spark, d, "documents").select("doc_id", "text"))
    return t.select("doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest"))


def lexical_index(spark, d):
    ix = lexical.lexical_index(_corpus(spark, d))
    return ix.postings.join(ix.terms, "term").select("chunk_id", "term", "tf", "dl", "df")


def _appended(spark, d):
    """The index of the corpus, stored in two appends."""
    c = _corpus(spark, d)
    return lexical.lexical_index(c.where("chunk_id % 3 = 0")).append(c.where("chunk_id % 3 <> 0"))


def appended_index(spark, d):
    ix = _appended(spark, d)
    return ix.postings.join(ix.terms, "term").select("chunk_id", "term", "tf", "dl", "df")


def bm25_appended(spark, d):
    return _out(lexical.bm25(_asked(spark, d), _appended(spark, d), 10), "query_id", "chunk_id")


def lexical_stats(spark, d):
    ix = lexical.lexical_index(_corpus(spark, d))
    return ix.stats.select("n_chunks", F.round("avg_len", 6).alias("avg_len"))


def bm25(spark, d):
    return _out(lexical.bm25(_asked(spark, d), lexical.lexical_index(_corpus(spark, d)), 10), "query_id", "chunk_id")


def bm25_boosted(spark, d):
    c = dv.chunks(spark, d)
    found = lexical.bm25_boosted(dv.benchmark_questions(spark, d), c, lexical.lexical_index(c), 5, "table")
    return _out(found, "query_id", "chunk_id")


def keyword_search(spark, d):
    return _out(lexical.keyword_search(dv.questions(spark, d), dv.chunks(spark, d), 5), "query_id", "chunk_id")


def _pages(spark, d):
    return dv.doc_lines(spark, d).select("doc_id", (F.col("line_no") + 1).alias("page_num"), F.col("line").alias("text"))


def best_snippets(spark, d):
    return _out(lexical.best_snippets(dv.questions(spark, d), _pages(spark, d)), "query_id", "page_num", "snippet")


def _short_questions(spark, d):
    """Element labels and word pairs as search box input."""
    q = dv.questions(spark, d)
    words = F.split("query", " ")
    short = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Table "), (F.col("doc_id") % 7 + 1).cast("string"))).otherwise(
        F.concat_ws(" ", F.element_at(words, -1), F.element_at(words, -2))
    )
    return q.select("query_id", "doc_id", short.alias("query"))


def search_elements(spark, d):
    c = dv.chunks(spark, d).where("chunk_type = 'text'")
    found = lexical.search_elements(_short_questions(spark, d), dv.elements(spark, d), c)
    return _out(found, "query_id", "kind", "label", "page_num", "item")


def keyword_boost(spark, d):
    r = lexical.keyword_search(dv.questions(spark, d), dv.chunks(spark, d), 5)
    r = r.withColumn("score", F.col("score") / 20).join(dv.chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    return _out(lexical.keyword_boost(r, ["the", "tion", "ver", "que"], ["of the"]), "query_id", "chunk_id")


def best_element(spark, d):
    return lexical.best_element(dv.questions(spark, d), dv.elements(spark, d))


def select_elements(spark, d):
    return lexical.select_elements(dv.questions(spark, d), dv.elements(spark, d))


def _two_rankings(spark, d):
    ix = lexical.lexical_index(_corpus(spark, d))
    q = _asked(spark, d)
    half = q.withColumn("query", F.array_join(F.filter(F.split("query", " "), lambda w, i: i % 2 == 0), " "))
    return lexical.bm25(q, ix, 20), lexical.bm25(half, ix, 20)


def rrf(spark, d):
    return _out(fusion.rrf(list(_two_rankings(spark, d)), 10), "query_id", "chunk_id")


def best_rows(spark, d):
    b = fusion.best_rows(list(_two_rankings(spark, d)))
    return b.select("query_id", "chunk_id", F.round("best_score", 6).alias("best_score"))


def _embedded(df, text="query"):
    return vectors.hash_embed(df, text=text)


def hybrid(spark, d):
    c = _corpus(spark, d)
    return _out(fusion.hybrid(_embedded(_asked(spark, d)), _embedded(c, "text"), lexical.lexical_index(c), 10), "query_id", "chunk_id")


def multi_query_hybrid(spark, d):
    c = dv.chunks(spark, d)
    v = queries.query_variants(dv.benchmark_questions(spark, d))
    return _out(fusion.multi_query_hybrid(_embedded(v), _embedded(c, "text"), lexical.lexical_index(c), 5), "query_id", "chunk_id")


def parent_child(spark, d):
    c = dv.chunks(spark, d)
    r = lexical.bm25(dv.questions(spark, d), lexical.lexical_index(c), 15)
    return _out(fusion.parent_child(r, c, 5), "query_id", "doc_id", "page_num", "chunk_id")


def _found(spark, d):
    return lexical.bm25(_asked(spark, d), lexical.lexical_index(_corpus(spark, d)), 20)


def rerank(spark, d):
    c = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.split("text", "\n", -1)[0].alias("caption"))
    return _out(fusion.rerank(_asked(spark, d), _found(spark, d), c, 10), "query_id", "chunk_id")


def _contexts(spark, d):
    hits = _found(spark, d).join(_corpus(spark, d), "chunk_id").withColumn("score", F.round(F.col("score") / 100, 6))
    facts = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    b = table(spark, d, "benchmark")
    facts = b.join(facts, F.col("item_id") % 25 == F.col("n_nationkey")).select(
        F.col("item_id").alias("query_id"), F.col("n_nationkey").alias("fact_no"),
        F.concat("n_name", F.lit(" in "), "r_name", F.lit(" on the")).alias("text"),
    )
    return fusion.all_contexts(hits, facts)


def all_contexts(spark, d):
    return _contexts(spark, d).select("query_id", "id", "source_type", F.length("text").alias("chars"), F.round("score", 6).alias("score"))


def rerank_ngrams(spark, d):
    return _out(fusion.rerank_ngrams(_asked(spark, d), _contexts(spark, d), 6), "query_id", "id", "source_type")


def build_context(spark, d):
    return fusion.build_context(fusion.rerank_ngrams(_asked(spark, d), _contexts(spark, d), 6))


def collect_citations(spark, d):
    e = dv.elements(spark, d)
    src = e.select(
        F.col("doc_id").alias("answer_id"), F.col("line_no").alias("pos"),
        F.when(F.col("line_no") % 4 == 3, "text").otherwise(F.col("element_type")).alias("source_type"),
        (F.col("number") % 3).alias("number"), "page_num",
    )
    return fusion.collect_citations(src).select("answer_id", F.array_join("citations", " ").alias("citations"))


def rank_chunks(spark, d):
    rows = dv.doc_lines(spark, d).select("doc_id", F.col("line_no").alias("chunk_no"), F.replace("line", F.lit("est"), F.lit("loss f1")).alias("text"))
    return fusion.rank_chunks(rows, 5).select("doc_id", "chunk_no", "score", "rank")


def _routed(spark, d):
    return _embedded(queries.classify_queries(dv.benchmark_questions(spark, d)))


def route_retrieve(spark, d):
    c = dv.chunks(spark, d)
    return _out(fusion.route_retrieve(_routed(spark, d), c, _embedded(c, "text").select("chunk_id", "embedding", "chunk_type"), lexical.lexical_index(c), 5), "query_id", "chunk_id", "strategy")


def retrieve(spark, d):
    c = dv.chunks(spark, d)
    v = _embedded(queries.query_variants(dv.benchmark_questions(spark, d)))
    return _out(fusion.retrieve(_routed(spark, d), v, c, _embedded(c, "text").select("chunk_id", "embedding", "chunk_type"), lexical.lexical_index(c), 5), "query_id", "chunk_id")


def extractive_answers(spark, d):
    q, c, e = dv.questions(spark, d), dv.chunks(spark, d), dv.elements(spark, d)
    found = lexical.bm25(q, lexical.lexical_index(c), 1)
    abstracts = table(spark, d, "documents").select("doc_id", F.split("text", "\n", -1)[0].alias("abstract"))
    return fusion.extractive_answers(q, _pages(spark, d), found, c, lexical.select_elements(q, e), abstracts)


QUERIES = {
    "vec1_hash_embed": hash_embed,
    "vec2_knn": knn,
    "vec2_knn_blocks": knn_blocks,
    "vec2_knn_cells": knn_cells,
    "vec3_knn_cells_typed": knn_cells_typed,
    "vec3_knn_where": knn_where,
    "vec4_upsert_vectors": upsert_vectors,
    "lex1_tokens": tokens,
    "lex2_lexical_index": lexical_index,
    "lex2_appended_index": appended_index,
    "lex3_bm25_appended": bm25_appended,
    "lex2_lexical_stats": lexical_stats,
    "lex3_bm25": bm25,
    "lex4_bm25_boosted": bm25_boosted,
    "lex5_keyword_search": keyword_search,
    "lex6_best_snippets": best_snippets,
    "lex7_search_elements": search_elements,
    "lex8_keyword_boost": keyword_boost,
    "lex9_best_element": best_element,
    "lex10_select_elements": select_elements,
    "fus1_rrf": rrf,
    "fus1_best_rows": best_rows,
    "fus2_hybrid": hybrid,
    "fus3_multi_query_hybrid": multi_query_hybrid,
    "fus4_parent_child": parent_child,
    "fus5_rerank": rerank,
    "fus6_rerank_ngrams": rerank_ngrams,
    "fus7_retrieve": retrieve,
    "fus8_route_retrieve": route_retrieve,
    "fus9_build_context": build_context,
    "fus10_collect_citations": collect_citations,
    "fus11_extractive_answers": extractive_answers,
    "rnk1_rank_chunks": rank_chunks,
    "set1_all_contexts": all_contexts,
}


# ---- SQL ------------------------------------------------------------------------------------------

_TOKEN = fv.TOKEN


def sql_tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '{_TOKEN}'), lambda t: length(t) > 1)"


def sql_bm25(name: str, asked: str, corpus: str, k: int, prefix: str) -> str:
    """CTEs ``prefix``_* and ``name`` (query_id, chunk_id, score, rank) over asked(query_id, query), corpus(chunk_id, text)."""
    p = prefix
    return f"""{p}_tok as (select chunk_id, {sql_tokens('text')} as toks from {corpus}),
      {p}_post as (select chunk_id, term, count(*) as tf from (select chunk_id, unnest(toks) as term from {p}_tok) group by all),
      {p}_len as (select chunk_id, len(toks) as dl from {p}_tok),
      {p}_st as (select count(*) as n, avg(dl) as al from {p}_len),
      {p}_df as (select term, count(*) as df from {p}_post group by 1),
      {p}_q as (select query_id, term, count(*) as qf from (select query_id, unnest({sql_tokens('query')}) as term from {asked}) group by all),
      {p}_score as (
        select query_id, chunk_id, sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / al)) * qf) as score
        from {p}_q join {p}_post using (term) join {p}_df using (term) join {p}_len using (chunk_id) cross join {p}_st group by all),
      {name} as (select * from (select query_id, chunk_id, score, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id)::int as rank from {p}_score) where rank <= {k})"""


_CORPUS = "corpus as (select doc_id as chunk_id, text from documents), asked as (select item_id as query_id, text as query from benchmark)"
_TOP = "select query_id, chunk_id, rank, round(score, 6) as score from"


def _sql_knn(k: int, where: str = "true") -> str:
    return f"""with s as (select q.vec_id as query_id, v.vec_id as chunk_id, round(list_dot_product(q.embedding::double[], v.embedding::double[]), 9) as score
        from embeddings q, embeddings v where {where}),
      r as (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from s)
      {_TOP} r where rank <= {k}"""


def sql_hash(x: str) -> str:
    h = f"sha256({x})"
    return f"(select list(('0x' || substring(h, 2 * i + 1, 2))::int / 255.0::double * 2 - 1 order by i) from (select {h} as h), range(32) t(i))"


_HASH = """v as (
    select {key}, list_transform(range(64), lambda i: ((instr('0123456789abcdef', h[(i % 32) * 2 + 1]) - 1) * 16 + instr('0123456789abcdef', h[(i % 32) * 2 + 2]) - 1) / 255.0::double * 2 - 1) as raw
    from (select *, sha256({text}) as h from {table}))"""

_KEY_TERMS = f"""list_filter(t, lambda x, i: list_position(t, x) = i)"""
_STOP = ", ".join(f"'{w}'" for w in fv.QUERY_STOP_WORDS)
_FOCUS = "rtrim(trim(query), '? ')"
_FOCUS_CASE = "case " + " ".join(
    f"when starts_with(lower({_FOCUS}), '{p}') then trim(substring({_FOCUS}, {len(p) + 1}), ' .')" for p in fv.FOCUS_PREFIXES
) + f" else trim(regexp_extract({_FOCUS}, '(?:about|for|of)\\s+([A-Za-z][A-Za-z0-9\\- ]{{2,}})', 1)) end"


def _sql_has(x: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, '{w}')" for w in words) + ")"


_TERMS = f"""{dv.SQL_QUESTIONS},
  qt as (select *, {_KEY_TERMS} as terms, {_FOCUS_CASE} as focus, {_sql_has('lower(query)', fv.SUMMARY_WORDS)} as summary from (
    select *, list_filter(regexp_extract_all(lower(query), '[a-z][a-z0-9\\-]+'), lambda x: x not in ({_STOP})) as t from questions))"""

_KEYWORD = f"""{_TERMS}, {dv.SQL_CHUNKS},
  ks as (select query_id, chunk_id, len(list_filter(terms, lambda x: contains(lower(text), x)))
      + case when len(terms) > 1 and len(list_filter(range(1, len(terms)), lambda i: contains(lower(text), terms[i] || ' ' || terms[i + 1]))) > 0 then 1.5 else 0 end::double as score
    from qt join chunks using (doc_id)),
  kw as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from ks where score > 0) where rank <= 5)"""

_EXCERPT = """case when c = '' then '' when hit > 0 then (case when s > 0 then '... ' else '' end) || trim(substring(c, s + 1, e - s), ' ,.;') || (case when e < length(c) then ' ...' else '' end)
   else trim(substring(c, 1, 320), """ + dv.WS + """) || (case when length(c) > 320 then ' ...' else '' end) end"""


def _fs(x: str) -> str:
    return f"""case when {x} = '' then 0.0 when contains(lower({x}), q) then 2.0
      else len(list_filter(list_filter(string_split_regex(q, '\\s+'), lambda w: w <> ''), lambda w: contains(lower({x}), w))) / greatest(len(list_filter(string_split_regex(q, '\\s+'), lambda w: w <> '')), 1) end"""


def _ids(x: str, cls: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, '{cls}+'))"


_METRIC = " + ".join(f"(case when contains(q, '{w}') and contains(t, '{w}') then 30 else 0 end)" for w in fv.METRIC_WORDS)
_ARCH = " + ".join(f"(case when contains(t, '{w}') then 15 else 0 end)" for w in fv.ARCHITECTURE_TEXT_WORDS)
_BEST = f"""bs as (select query_id, element_type, number, page_num, chunk_id, case element_type
    when 'equation' then (case when regexp_extract(q, '\\b(?:equation|eq\\.?)\\s*[(\\[]?\\s*(\\d+)', 1) = number::varchar then 100 else 0 end) + len(list_intersect({_ids('q', '[a-zA-Z0-9_\\-()]')}, {_ids('t', '[a-zA-Z0-9_\\-()]')}))
    when 'table' then {_METRIC} + (case when regexp_extract(q, '\\btable\\s+(\\d+)\\b', 1) = number::varchar then 100 else 0 end) + len(list_intersect({_ids('q', '[a-zA-Z0-9\\-]')}, {_ids('t', '[a-zA-Z0-9\\-]')}))
    else (case when {_sql_has('q', fv.ARCHITECTURE_QUERY_WORDS)} then {_ARCH} else 0 end) + len(list_intersect({_ids('q', '[a-zA-Z0-9\\-]')}, {_ids('t', '[a-zA-Z0-9\\-]')})) end::bigint as score
    from (select query_id, doc_id, lower(query) as q, e.*exclude (doc_id), lower(caption || ' ' || e.text) as t from questions join elements e using (doc_id)))"""

_CONTEXTS = f"""{_CORPUS}, {sql_bm25('found', 'asked', 'corpus', 20, 'b')},
  contexts as (
    select query_id, 'Chunk ' || chunk_id as id, text, 'Vector Chunk' as source_type, round(score / 100, 6) as score from found join corpus using (chunk_id)
    union all
    select item_id, 'KG Triplet ' || n_nationkey, n_name || ' in ' || r_name || ' on the', 'Knowledge Graph', 0.0
    from benchmark join nation on item_id % 25 = n_nationkey join region on n_regionkey = r_regionkey)"""


def _jac(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) / greatest(len(list_distinct(list_concat({a}, {b}))), 1)"


_NGRAMS = f"""{_CONTEXTS},
  w as (select c.*, {dv.sql_words('lower(query)')} as qw, {dv.sql_words('lower(c.text)')} as cw from contexts c join asked using (query_id)),
  g as (select *, list_distinct(list_transform(range(1, len(qw)), lambda i: qw[i] || ' ' || qw[i + 1])) as qb, list_distinct(list_transform(range(1, len(cw)), lambda i: cw[i] || ' ' || cw[i + 1])) as cb from w),
  s as (select query_id, id, text, source_type, score + 0.6 * ({_jac('list_distinct(qw)', 'list_distinct(cw)')}) + 0.4 * ({_jac('qb', 'cb')}) + case when source_type = 'Knowledge Graph' then 0.05 else 0 end as score from g),
  r as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id)::int as rank from s) where rank <= 6)"""

ORACLES = {
    "vec1_hash_embed": f"""with {_HASH.format(key='doc_id', text='text', table='documents')},
      n as (select doc_id, raw, sqrt(list_sum(list_transform(raw, lambda x: x * x))) as norm from v)
      select doc_id, len(raw)::int as dims, round(raw[1] / norm, 6) as v0, round(raw[32] / norm, 6) as v31, round(raw[64] / norm, 6) as v63,
        round(list_sum(list_transform(raw, lambda x, i: x / norm * (i - 1))), 6) as weighted from n""",
    "vec2_knn": _sql_knn(10),
    "vec2_knn_blocks": _sql_knn(10),
    "vec3_knn_where": _sql_knn(5, "v.label = 3"),
    "vec4_upsert_vectors": "select vec_id as chunk_id, label from embeddings where label = 1",
    "lex1_tokens": f"select doc_id, len(t)::int as n_tokens, md5(array_to_string(t, ' ')) as digest from (select doc_id, {sql_tokens('text')} as t from documents)",
    "lex2_lexical_index": f"""with t as (select doc_id as chunk_id, {sql_tokens('text')} as toks from documents),
      p as (select chunk_id, term, count(*)::int as tf, any_value(dl)::int as dl from (select chunk_id, len(toks) as dl, unnest(toks) as term from t) group by chunk_id, term)
      select *, count(*) over (partition by term) as df from p""",
    "lex2_lexical_stats": f"select count(*) as n_chunks, round(avg(len({sql_tokens('text')})), 6) as avg_len from documents",
    "lex3_bm25": f"with {_CORPUS}, {sql_bm25('b', 'asked', 'corpus', 10, 'x')} {_TOP} b",
    "lex5_keyword_search": f"with {_KEYWORD} {_TOP} kw",
    "lex6_best_snippets": f"""with {_TERMS}, {dv.SQL_LINES},
      p as (select qt.*, line_no + 1 as page_num, {dv.sql_squeeze('line')} as c from qt join lines using (doc_id)),
      s0 as (select *, (len(list_filter(terms, lambda x: contains(lower(c), x))) + case when focus <> '' and contains(lower(c), lower(focus)) then 4 else 0 end
        + case when summary and page_num = 1 then 1.5 else 0 end)::double as score, case when focus <> '' then focus else coalesce(terms[1], '') end as term from p where c <> ''),
      r as (select *, row_number() over (partition by query_id order by score desc, page_num)::int as rank, case when term = '' then 0 else instr(lower(c), lower(term)) end as hit from s0 where score > 0),
      x as (select *, greatest(0, hit - 1 - 160) as s, least(length(c), hit - 1 + length(term) + 160) as e from r where rank <= 2)
      select query_id, page_num::int as page_num, {_EXCERPT} as snippet, rank, round(score, 6) as score from x""",
    "lex7_search_elements": f"""with {dv.SQL_QUESTIONS}, {dv.SQL_CHUNKS},
      a as (select query_id, doc_id, lower(case when doc_id % 4 = 1 then 'Table ' || (doc_id % 7 + 1) else string_split(query, ' ')[-1] || ' ' || string_split(query, ' ')[-2] end) as q from questions),
      f as (
        select query_id, element_type as kind, upper(element_type[1]) || element_type[2:] || ' ' || number as label, page_num,
          case when q in (element_type || ' ' || number, element_type || number) or (element_type = 'equation' and q = 'eq ' || number) or (element_type = 'figure' and q = 'fig ' || number) then 10.0
            else greatest({_fs('caption')}, {_fs('text')}, {_fs('section')}) end::double as score, chunk_id as item, 0.3 as floor from a join elements using (doc_id)
        union all
        select query_id, 'keyword', section, page_num, ({_fs('text')})::double, chunk_id, 0.5 from a join chunks using (doc_id) where chunk_type = 'text'),
      r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, kind, item)::int as rank from f where score > floor)
      select query_id, kind, label, page_num, item, rank, round(score, 6) as score from r where rank <= 20""",
    "lex8_keyword_boost": f"""with {_KEYWORD},
      b as (select query_id, chunk_id, least(1.0, score / 20 + 0.1 * (len(list_filter(['the', 'tion', 'ver', 'que'], lambda w: contains(lower(text), w))) + case when contains(lower(text), 'of the') then 5 else 0 end))::double as score
        from kw join chunks using (chunk_id))
      select query_id, chunk_id, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id)::int as rank, round(score, 6) as score from b""",
    "lex9_best_element": f"""with {dv.SQL_QUESTIONS}, {dv.SQL_ELEMENTS}, {_BEST}
      select query_id, element_type, number, chunk_id, score from bs qualify row_number() over (partition by query_id, element_type order by score desc, number, page_num, chunk_id) = 1""",
    "fus1_rrf": f"""with {_CORPUS}, halves as (select query_id, array_to_string(list_filter(string_split(query, ' '), lambda w, i: i % 2 = 1), ' ') as query from asked),
      {sql_bm25('a', 'asked', 'corpus', 20, 'x')}, {sql_bm25('b', 'halves', 'corpus', 20, 'y')},
      f as (select query_id, chunk_id, sum(1.0::double / (60 + rank)) as score from (select * from a union all select * from b) group by all),
      r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id)::int as rank from f) {_TOP} r where rank <= 10""",
    "fus1_best_rows": f"""with {_CORPUS}, halves as (select query_id, array_to_string(list_filter(string_split(query, ' '), lambda w, i: i % 2 = 1), ' ') as query from asked),
      {sql_bm25('a', 'asked', 'corpus', 20, 'x')}, {sql_bm25('b', 'halves', 'corpus', 20, 'y')}
      select query_id, chunk_id, round(max(score), 6) as best_score from (select * from a union all select * from b) group by query_id, chunk_id""",
    "fus2_hybrid": f"""with {_CORPUS}, {sql_bm25('lex', 'asked', 'corpus', 30, 'x')},
      {_HASH.format(key='chunk_id', text='text', table='corpus').replace('v as', 'cv as')},
      {_HASH.format(key='query_id', text='query', table='asked').replace('v as', 'qv as')},
      cn as (select chunk_id, list_transform(raw, lambda x: x / sqrt(list_sum(list_transform(raw, lambda y: y * y)))) as e from cv),
      qn as (select query_id, list_transform(raw, lambda x: x / sqrt(list_sum(list_transform(raw, lambda y: y * y)))) as e from qv),
      dense as (select * from (select query_id, chunk_id, 0.0::double as score, row_number() over (partition by query_id order by round(list_dot_product(qn.e, cn.e), 9) desc, chunk_id)::int as rank from qn, cn) where rank <= 30),
      f as (select query_id, chunk_id, sum(1.0::double / (60 + rank)) as score from (select * from lex union all select * from dense) group by all),
      r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id)::int as rank from f) {_TOP} r where rank <= 10""",
    "fus4_parent_child": f"""with {dv.SQL_QUESTIONS}, {dv.SQL_CHUNKS}, {sql_bm25('b', 'questions', 'chunks', 15, 'x')},
      p as (select query_id, doc_id, page_num, sum(score) as score, arg_min(chunk_id, (-round(score, 9), chunk_id)) as chunk_id from b join chunks using (chunk_id) group by all),
      r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id, page_num)::int as rank from p)
      select query_id, doc_id, page_num, chunk_id, rank, round(score, 6) as score from r where rank <= 5""",
    "fus5_rerank": f"""with {_CORPUS}, {sql_bm25('found', 'asked', 'corpus', 20, 'b')},
      t as (select f.query_id, chunk_id, f.score, list_distinct({sql_tokens('query')}) as qt, list_distinct({sql_tokens('c.text')}) as ct,
        list_distinct({sql_tokens('string_split(c.text, chr(10))[1]')}) as mt from found f join asked using (query_id) join corpus c using (chunk_id)),
      s as (select query_id, chunk_id, score * 0.4::double + 0.6::double * ({_jac('qt', 'ct')} + 0.3::double * len(list_intersect(qt, mt)) / greatest(len(qt), 1)) as score from t),
      r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id)::int as rank from s) {_TOP} r where rank <= 10""",
    "fus6_rerank_ngrams": f"with {_NGRAMS} select query_id, id, source_type, rank, round(score, 6) as score from r",
    "fus9_build_context": f"""with {_NGRAMS},
      b as (select query_id, source_type, rank, row_number() over (partition by query_id, source_type order by rank) as n,
        case when source_type = 'Vector Chunk' then rtrim(text, {dv.WS}) else text end as t from r),
      l as (select query_id, source_type, string_agg('**[' || case when source_type = 'Vector Chunk' then 'V' else 'G' end || n || ']** ' || t, chr(10) || chr(10) order by n) as body from b group by all),
      vx as (select query_id, '### 📄 Vector Evidence (semantic passages)' || chr(10) || chr(10) || body as x from l where source_type = 'Vector Chunk'),
      gx as (select query_id, chr(10) || '### 🔗 Knowledge-Graph Facts (structured triplets)' || chr(10) || chr(10) || body as x from l where source_type <> 'Vector Chunk')
      select query_id, {dv.sql_strip("concat_ws(chr(10) || chr(10), vx.x, gx.x)")} as context from (select distinct query_id from r) left join vx using (query_id) left join gx using (query_id)""",
    "fus10_collect_citations": f"""with {dv.SQL_ELEMENTS},
      l as (select doc_id as answer_id, line_no as pos, case when line_no % 4 = 3 then '(Source: Page ' || page_num || ')'
        else '(Source: ' || upper(element_type[1]) || element_type[2:] || ' ' || (number % 3) || ')' end as label from elements),
      f as (select answer_id, label, min(pos) as pos from l group by all)
      select answer_id, string_agg(label, ' ' order by pos) as citations from f group by answer_id""",
    "rnk1_rank_chunks": f"""with {dv.SQL_LINES}, t as (select doc_id, line_no::int as chunk_no, replace(line, 'est', 'loss f1') as x from lines),
      s as (select doc_id, chunk_no, ({' + '.join(f"contains(lower(x), '{w}')::int" for w in fv.PRIORITY_KEYWORDS)} + contains(x, '##')::int)::int as score from t),
      r as (select *, row_number() over (partition by doc_id order by score desc, chunk_no)::int as rank from s) select * from r where rank <= 5""",
    "set1_all_contexts": f"with {_CONTEXTS} select query_id, id, source_type, length(text)::int as chars, round(score, 6) as score from contexts",
}
ORACLES |= {"vec2_knn_cells": ORACLES["vec2_knn"], "vec3_knn_cells_typed": ORACLES["vec3_knn_where"]}
ORACLES |= {"lex2_appended_index": ORACLES["lex2_lexical_index"], "lex3_bm25_appended": ORACLES["lex3_bm25"]}
