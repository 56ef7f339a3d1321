"""Registered queries for answer checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from litmill.functions import fixed_values as fv
from litmill.operators import lexical, queries, validation
from litmill.plans import derived as dv
from litmill.plans.retrieval import sql_bm25
from litmill.plans.tables import table


def _registry(spark, d):
    return dv.elements(spark, d).where("number <> 2").select("doc_id", "element_type", "number", "chunk_id")


def _responses(spark, d):
    """Answers about documents: references, numbers and hedges in front of the text."""
    c = queries.classify_queries(dv.questions(spark, d))
    t = table(spark, d, "documents").select("doc_id", "text", "n_chars")
    n = (F.col("doc_id") % 9).cast("string")
    head = F.concat(
        F.lit("Equation "), n, F.lit(" and Table #2 probably show "), F.col("n_chars").cast("string"), F.lit(" or "), (F.col("n_chars") + 11).cast("string"),
        F.lit(", maybe 3.25 and 1000, 2000 likely; Fig. "), n, F.lit(". "),
    )
    text = F.when(F.col("doc_id") % 3 == 0, F.lit("Short. See figure 2")).when(F.col("doc_id") % 3 == 1, F.concat(head, "text")).otherwise(F.col("text"))
    return c.join(t, "doc_id").select(F.col("query_id").alias("response_id"), "doc_id", "query_type", "target_number", text.alias("text"))


SQL_RESPONSES = f"""{dv.SQL_QUESTIONS},
  responses as (select doc_id as response_id, doc_id, case doc_id % 3 when 0 then 'Short. See figure 2' when 1 then 'Equation ' || (doc_id % 9) || ' and Table #2 probably show ' || n_chars || ' or ' || (n_chars + 11)
    || ', maybe 3.25 and 1000, 2000 likely; Fig. ' || (doc_id % 9) || '. ' || text else text end as text from documents join questions using (doc_id))"""


def relevance(spark, d):
    q = dv.benchmark_questions(spark, d)
    c = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    r = validation.relevance(q, lexical.bm25(q, lexical.lexical_index(c), 3), c)
    return r.select("query_id", F.round("relevance", 6).alias("relevance"))


def invalid_refs(spark, d):
    return validation.invalid_refs(_responses(spark, d), _registry(spark, d))


def correct_refs(spark, d):
    return validation.correct_refs(_responses(spark, d), _registry(spark, d))


def type_conflicts(spark, d):
    r = validation.type_conflicts(_responses(spark, d))
    return r.select("response_id", F.array_join("type_conflicts", ",").alias("conflicts"))


def _sources(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("response_id"), F.concat_ws(" ", F.col("n_chars").cast("string"), "text").alias("text"))


def unsupported_numbers(spark, d):
    u = validation.unsupported_numbers(_responses(spark, d), _sources(spark, d))
    return u.select("response_id", F.array_join("unsupported", ",").alias("unsupported"), F.array_join("hedges", ",").alias("hedges"), "flags")


def completeness(spark, d):
    c = validation.completeness(_responses(spark, d))
    return c.select("response_id", F.array_join("incomplete", ",").alias("incomplete"))


def repetition(spark, d):
    r = validation.repetition(table(spark, d, "documents").select("doc_id", "text"))
    return r.select("doc_id", F.round("repetition_rate", 6).alias("repetition_rate"), "repetitive")


def validate(spark, d):
    out = None
    rel = dv.questions(spark, d).select(F.col("query_id").alias("response_id"), ((F.col("doc_id") % 10) / 10.0).alias("relevance"))
    for level in fv.LEVELS:
        v = validation.validate(_responses(spark, d), _registry(spark, d), _sources(spark, d), rel, level).withColumn("level", F.lit(level))
        out = v if out is None else out.unionByName(v)
    return out.withColumn("confidence", F.round("confidence", 6))


def answer_flags(spark, d):
    return validation.answer_flags(table(spark, d, "conversations")).select("conv_id", "turn", "looks_broken", "looks_like_refusal")


QUERIES = {
    "val1_relevance": relevance,
    "val2_invalid_refs": invalid_refs,
    "val3_correct_refs": correct_refs,
    "val4_type_conflicts": type_conflicts,
    "val5_unsupported_numbers": unsupported_numbers,
    "val6_completeness": completeness,
    "val7_repetition": repetition,
    "val8_validate": validate,
    "val9_answer_flags": answer_flags,
}

_HEDGES = "[" + ", ".join(f"'{h}'" for h in fv.HEDGES) + "]"
_NUMS = "regexp_extract_all({x}, '\\b(\\d+\\.?\\d*)\\b', 1)"

ORACLES = {
    "val1_relevance": f"""with {dv.SQL_BENCHMARK_QUESTIONS}, corpus as (select doc_id as chunk_id, text from documents), {sql_bm25('b', 'bquestions', 'corpus', 3, 'x')},
      t as (select distinct query_id, unnest(list_filter(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}'))) as t from bquestions),
      h as (select distinct query_id, t from t join b using (query_id) join corpus using (chunk_id) where contains(lower(text), t))
      select q.query_id, round((select count(*) from h where h.query_id = q.query_id)::double / greatest((select count(*) from t where t.query_id = q.query_id), 1), 6) as relevance from bquestions q""",
    "val2_invalid_refs": f"""with {SQL_RESPONSES}, {dv.SQL_ELEMENTS}, l as (select response_id, doc_id, lower(text) as t from responses),
      f as (select response_id, doc_id, 'equation' as element_type, unnest(regexp_extract_all(t, '\\b(?:equation|eq\\.)\\s*#?\\s*(\\d+)\\b', 1))::bigint as number from l
        union select response_id, doc_id, 'table', unnest(regexp_extract_all(t, '\\b(?:table|tbl\\.)\\s*#?\\s*(\\d+)\\b', 1))::bigint from l
        union select response_id, doc_id, 'figure', unnest(regexp_extract_all(t, '\\b(?:figure|fig\\.)\\s*#?\\s*(\\d+)\\b', 1))::bigint from l)
      select response_id, element_type, number from f where not exists (select 1 from elements e where e.number <> 2 and e.doc_id = f.doc_id and e.element_type = f.element_type and e.number = f.number)""",
    "val5_unsupported_numbers": f"""with {SQL_RESPONSES}, n as (select response_id, {_NUMS.format(x='r.text')} as nums, lower(r.text) as low, {_NUMS.format(x="d.n_chars || ' ' || d.text")} as have from responses r join documents d on d.doc_id = r.doc_id),
      u as (select response_id, list_filter(nums, lambda x: length(x) > 2 and not list_contains(have, x)) as bad, list_filter({_HEDGES}, lambda h: contains(low, h)) as hd from n)
      select response_id, array_to_string(bad, ',') as unsupported, array_to_string(hd, ',') as hedges, (case when len(hd) > 2 then 1 else 0 end + case when len(bad) > 3 then 1 else 0 end)::int as flags from u""",
    "val7_repetition": f"""with s as (select doc_id, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: lower({dv.sql_strip('x')})), lambda x: length(x) > 10) as s from documents)
      select doc_id, round(case when len(s) > 0 then 1 - len(list_distinct(s))::double / len(s) else 0 end, 6)::double as repetition_rate, len(s) > 5 and len(list_distinct(s)) < len(s) * 0.7 as repetitive from s""",
    "val9_answer_flags": f"""select conv_id, turn, {' or '.join(f"regexp_matches(text, '{p}')" for p in fv.BROKEN_ANSWER)} or text = '' as looks_broken,
      text = '' or contains(lower(text), 'the document does not contain this information') as looks_like_refusal from conversations""",
}
