"""Registered queries on tables of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from litmill.functions import fixed_values as fv
from litmill.operators import queries
from litmill.plans import derived as dv
from litmill.plans.retrieval import _sql_has
from litmill.plans.tables import table


def classify_queries(spark, d):
    c = queries.classify_queries(dv.questions(spark, d))
    return c.withColumn("target_numbers", F.array_join(F.transform("target_numbers", lambda n: n.cast("string")), ","))


def query_flags(spark, d):
    return queries.query_flags(dv.questions(spark, d))


def seed_terms(spark, d):
    q = dv.questions(spark, d)
    quoted = F.concat(F.lit('"'), F.element_at(F.split("query", " "), -1), F.lit('" '), F.initcap("query"))
    return queries.seed_terms(q.withColumn("query", quoted))


def query_variants(spark, d):
    return queries.query_variants(dv.questions(spark, d))


def expand_queries(spark, d):
    out = None
    for name in queries.STRATEGIES:
        e = queries.expand_queries(dv.questions(spark, d), name, 5).withColumn("strategy", F.lit(name))
        out = e if out is None else out.unionByName(e)
    return out


def expand_context(spark, d):
    return queries.expand_queries(dv.questions(spark, d), "context_addition", 4)


def _scores(spark, d):
    ev = table(spark, d, "events")
    n = table(spark, d, "documents").agg(F.count("*").alias("n")).select("n").scalar()
    return ev.select((F.col("event_id") % n).alias("query_id"), ((F.col("event_id") % 97) / 100.0 * (F.col("event_id") % 500) / 300).alias("score"))


def expand_by_scores(spark, d):
    return queries.expand_by_scores(dv.questions(spark, d), _scores(spark, d))


def expansion_strategy(spark, d):
    return expand_by_scores(spark, d).select("query_id", "strategy").distinct()


def _history(spark, d):
    """User messages that were followed by an answer count as past questions."""
    t = dv.turns(spark, d)
    return t.select(F.col("user_query").alias("past_query"), F.concat("user_query", F.lit(" details")).alias("expansion"), (F.col("retrieval_score") + 0.01).alias("score"))


def _user_questions(spark, d):
    t = dv.turns(spark, d)
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("user_query").alias("query"))


def similar_queries(spark, d):
    s = queries.similar_queries(_user_questions(spark, d), _history(spark, d))
    return s.select("query_id", "past_query", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


def adaptive_expand(spark, d):
    q = _user_questions(spark, d)
    attempts = q.select("query_id", (F.col("query_id") % 3 + 1).alias("attempt"), ((F.col("query_id") % 10) / 10.0).alias("score"))
    return queries.adaptive_expand(q, attempts, queries.similar_queries(q, _history(spark, d)))


def decompose(spark, d):
    q = dv.questions(spark, d)
    forms = F.array(
        F.concat(F.lit("Compare "), "query", F.lit(" with table 3")),
        F.concat(F.lit("table 2 and equation "), (F.col("doc_id") % 9).cast("string"), F.lit(" for "), "query"),
        F.concat("query", F.lit(", then list its limits")),
        F.col("query"),
    )
    d_ = queries.decompose(q.withColumn("query", F.element_at(forms, (F.col("doc_id") % 4 + 1).cast("int"))))
    return d_.withColumn("dependencies", F.array_join(F.col("dependencies").cast("array<string>"), ","))


def _sub_answers(spark, d):
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), F.when(F.col("role") == "assistant", "synthesis").otherwise("retrieval").alias("sub_type"), F.col("text").alias("answer"))


def fuse_answers(spark, d):
    a = queries.fuse_answers(_sub_answers(spark, d)).withColumn("method", F.lit("concatenate"))
    b = queries.fuse_answers(_sub_answers(spark, d), "weighted").withColumn("method", F.lit("weighted"))
    return a.unionByName(b)


def keyword_query(spark, d):
    return queries.keyword_query(table(spark, d, "benchmark")).select("item_id", "keywords")


METADATA_ASKS = ["What is the title of the paper?", "Who wrote this?", "Which affiliations?", "When was it published?", "Show the abstract", "arXiv id please", "How big is it?"]


def metadata_answers(spark, d):
    docs = table(spark, d, "documents")
    ask = F.element_at(F.array(*map(F.lit, METADATA_ASKS)), (F.col("doc_id") % 7 + 1).cast("int"))
    q = docs.select(F.col("doc_id").alias("query_id"), "doc_id", ask.alias("query"))
    first = F.split("text", "\n", -1)[0]
    m = docs.select(
        "doc_id", F.substring(first, 1, 50).alias("title"), F.split("lang", ",").alias("authors"),
        F.when(F.col("lang") == "en", F.array("source")).otherwise(F.array().cast("array<string>")).alias("affiliations"),
        F.when(F.col("n_chars") % 2 == 0, "1999").otherwise("").alias("year"), first.alias("abstract"), F.col("source").alias("arxiv_id"),
    )
    return queries.metadata_answers(q, m)


QUERIES = {
    "qry1_classify_queries": classify_queries,
    "qry2_query_flags": query_flags,
    "qry3_seed_terms": seed_terms,
    "qry4_query_variants": query_variants,
    "qry5_expand_queries": expand_queries,
    "qry5_expand_context": expand_context,
    "qry6_expand_by_scores": expand_by_scores,
    "qry6_expansion_strategy": expansion_strategy,
    "qry6_adaptive_expand": adaptive_expand,
    "qry7_similar_queries": similar_queries,
    "qry8_decompose": decompose,
    "qry9_fuse_answers": fuse_answers,
    "qry10_keyword_query": keyword_query,
    "qry11_metadata_answers": metadata_answers,
}

_Q = "lower(trim(query))"


def _m(patterns):
    return "(" + " or ".join(f"regexp_matches(q, '{p}')" for p in patterns) + ")"


_VOTE = {k: " + ".join(f"contains(q, '{w}')::int" for w in ws) for k, ws in fv.TYPE_KEYWORDS.items()}
_SPEC = " ".join(
    f"when regexp_matches(q, '{p}') then ['specific_element', '{k}', regexp_extract(q, '{p}', 1), '', '1.0']" for k, ps in fv.SPECIFIC_PATTERNS.items() for p in ps
)
_COMP = " ".join(
    f"when regexp_matches(q, '{p}') then ['comparison', regexp_extract(q, '{p}', 1), '', regexp_extract(q, '{p}', 2) || ',' || regexp_extract(q, '{p}', 3), '0.95']" for p in fv.COMPARISON_PATTERNS
)
_LIST = " ".join(f"when regexp_matches(q, '{p}') then ['list_all', regexp_extract(q, '{p}', 1), '', '', '1.0']" for p in fv.LIST_ALL_PATTERNS)
_lists = {k: _sql_has("q", ws) for k, ws in fv.LIST_PHRASES.items()}
_FOCUS = "rtrim(trim(query), '? ')"
_FOCUS_CASE = "case " + " ".join(
    f"when starts_with(lower({_FOCUS}), '{p}') then trim(substring({_FOCUS}, {len(p) + 1}), ' .')" for p in fv.FOCUS_PREFIXES
) + f" else trim(regexp_extract({_FOCUS}, '(?:about|for|of)\\s+([A-Za-z][A-Za-z0-9\\- ]{{2,}})', 1)) end"
_VARIANTS = f"""[query] || case when {_sql_has('lower(query)', fv.SUMMARY_WORDS)} then {fv.SUMMARY_VARIANTS} else []::varchar[] end
  || case when {_sql_has('lower(query)', fv.LIMITATION_WORDS)} then {fv.LIMITATION_VARIANTS} else []::varchar[] end
  || case when (starts_with(lower(query), 'what is ') or starts_with(lower(query), 'what are ') or {_sql_has('lower(query)', fv.DEFINITION_WORDS)}) and f <> ''
       then [f, f || ' definition', 'what is ' || f] else []::varchar[] end"""
_UQ = f"""{dv.SQL_TURNS},
  uq as (select conv_id * 1000 + turn as query_id, user_query as query from turns),
  hist as (select user_query as past_query, max(retrieval_score + 0.01::double) as score from turns group by 1)"""

ORACLES = {
    "qry1_classify_queries": f"""with {dv.SQL_QUESTIONS}, l as (select *, {_Q} as q from questions),
      v as (select *, {_VOTE['equation']} as ve, {_VOTE['table']} as vt, {_VOTE['figure']} as vf from l),
      r as (select *, case when q = '' then ['general', null, '', '', '0.5'] when {_m(fv.CROSS_REFERENCE_PATTERNS)} then ['cross_reference', null, '', '', '0.9']
        {_COMP} {_LIST} {_SPEC} when greatest(ve, vt, vf) = 0 then ['general', null, '', '', '0.7'] when ve = greatest(ve, vt, vf) then ['equation', 'equation', '', '', '0.8']
        when vt = greatest(ve, vt, vf) then ['table', 'table', '', '', '0.8'] else ['figure', 'figure', '', '', '0.8'] end as x from v)
      select query_id, doc_id, query, x[1] as query_type, x[2] as target_type, nullif(x[3], '')::bigint as target_number, nullif(x[4], '') as target_numbers, x[5]::double as confidence from r""",
    "qry2_query_flags": f"""with {dv.SQL_QUESTIONS}, l as (select *, {_Q} as q from questions)
      select query_id, doc_id, query, {_lists['equation']} or {_lists['table']} or {_lists['figure']} as lists_all, {_sql_has('q', fv.SUMMARY_WORDS)} as asks_summary,
        {_sql_has('q', fv.LIMITATION_WORDS)} as asks_limitations, starts_with(lower(query), 'what is ') or starts_with(lower(query), 'what are ') or {_sql_has('q', fv.DEFINITION_WORDS)} as asks_definition,
        {_sql_has('q', fv.EXPLANATION_WORDS)} as asks_explanation, {_sql_has('q', fv.METADATA_WORDS)} as asks_metadata,
        case when {_sql_has('q', fv.MODE_EXPLANATION_WORDS)} then 'explanation' when {_sql_has('q', fv.ANALYSIS_WORDS)} then 'analysis' else 'standard' end as mode,
        case when {_sql_has('q', fv.COUNT_WORDS)} and {_sql_has('q', fv.ELEMENT_TYPES)} then 'count' when {_lists['equation']} then 'all_equations' when {_lists['table']} then 'all_tables'
          when {_lists['figure']} then 'all_figures' when {_sql_has('q', fv.ANSWER_EQUATION_WORDS)} or regexp_matches(q, '\\b(?:equation|eq\\.?)\\s*[(\\[]?\\s*\\d+') then 'specific_equation'
          when {_sql_has('q', fv.TABLE_WORDS)} then 'table' when {_sql_has('q', fv.FIGURE_QUERY_WORDS)} then 'figure' else 'general' end as answer_mode from l""",
    "qry4_query_variants": f"""with {dv.SQL_QUESTIONS}, f as (select query_id, trim(query) as query, trim(regexp_replace({_FOCUS_CASE}, '\\s+', ' ', 'g')) as f from questions),
      v as (select query_id, unnest({_VARIANTS}) as query, generate_subscripts({_VARIANTS}, 1) as i from f),
      u as (select * from v where query <> '' qualify row_number() over (partition by query_id, lower(query) order by i) = 1),
      n as (select query_id, (row_number() over (partition by query_id order by i) - 1)::int as variant_no, query from u) select * from n""",
    "qry5_expand_context": f"""with {dv.SQL_QUESTIONS}, t as (select query_id, unnest([query || ' in the document', query || ' according to the paper', query || ' details', query || ' explanation']) as expansion,
        unnest([0, 1, 2, 3]) as pos from (select query_id, trim(query) as query from questions)) select query_id, pos, expansion from t""",
    "qry6_expansion_strategy": f"""with {dv.SQL_QUESTIONS}, s as (select event_id % (select count(*) from documents) as query_id, avg((event_id % 97) / 100.0::double * (event_id % 500) / 300) as a from events group by 1)
      select query_id, case when coalesce(a, 0) < 0.25 then 'specificity_reduction' when a < 0.5 then 'multi_strategy' else 'synonym_injection' end as strategy from questions left join s using (query_id)""",
    "qry7_similar_queries": f"""with {_UQ},
      w as (select query_id, list_distinct({dv.sql_words('lower(query)')}) as qw from uq), h as (select past_query, score, list_distinct({dv.sql_words('lower(past_query)')}) as pw from hist),
      s as (select query_id, past_query, len(list_intersect(qw, pw)) / greatest(len(qw), len(pw)) as similarity, score from w, h),
      r as (select query_id, past_query, similarity, score * similarity as score, row_number() over (partition by query_id order by round(score * similarity, 9) desc, past_query) as rn from s where similarity > 0.5)
      select query_id, past_query, round(similarity, 6) as similarity, round(score, 6) as score from r where rn <= 10""",
    "qry9_fuse_answers": """with s as (select conv_id as query_id, turn as pos, role = 'assistant' as syn, text, row_number() over (partition by conv_id order by turn) as i from conversations)
      select query_id, 'concatenate' as method, string_agg(case when syn then text else '**Part ' || i || ' (retrieval):**' || chr(10) || text end, chr(10) || chr(10) order by pos) as answer from s group by 1
      union all
      select query_id, 'weighted', concat_ws(chr(10) || chr(10), '**Retrieved Information:**' || chr(10) || string_agg(text, chr(10) || chr(10) order by pos) filter (not syn),
        '**Analysis:**' || chr(10) || string_agg(text, chr(10) || chr(10) order by pos) filter (syn)) from s group by 1""",
    "qry10_keyword_query": f"""select item_id, array_to_string(list_filter({dv.sql_words("regexp_replace(text, '[^\\p{L}\\p{N}_\\s]', '', 'g')")}, lambda w: lower(w) not in ({', '.join(f"'{w}'" for w in fv.KEYWORD_QUERY_STOP_WORDS)}))[1:6], ' ') as keywords from benchmark""",
    "qry11_metadata_answers": f"""with t as (select doc_id as query_id, doc_id % 7 as f, string_split(text, chr(10))[1] as l, * from documents),
      v as (select query_id, ['title', 'authors', 'affiliations', 'year', 'abstract', 'arxiv_id'][f + 1] as field,
        case f when 0 then substring(l, 1, 50) when 1 then lang when 2 then case when lang = 'en' then source else '' end when 3 then case when n_chars % 2 = 0 then '1999' else '' end when 4 then l else source end as value from t where f < 6)
      select query_id, field, case when value <> '' then value || chr(10) || chr(10) || '(Source: Page 1)' else '{fv.NOT_CONTAINED}' end as answer from v""",
}
