"""Registered queries for the critical review of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from litmill.functions import review_values as rv
from litmill.operators import review
from litmill.plans import derived as dv
from litmill.plans.tables import dealt, table
from litmill.session import cut_lineage

# Words of the corpus that stand for review terms, so that the rules have something to find.
SWAPS = [("atand", "accuracy 91.5% on the benchmark "), ("tionre", "does not report the learning rate "), ("erst", "novel dataset "), ("ingan", "limited to memory ")]


def _text(c):
    for old, new in SWAPS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


_SQL_TEXT = "text"
for _old, _new in SWAPS:
    _SQL_TEXT = f"replace({_SQL_TEXT}, '{_old}', '{_new}')"


def _docs(spark, d):
    return dealt(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", _text(F.col("text")).alias("text"))


def _papers(spark, d):
    """Documents as papers: the lines are dealt to the sections in turn."""
    names = ["abstract", "introduction", "methodology", "results", "conclusion", "limitations", "future_work"]
    pick = lambda n: F.array_join(F.filter("_lines", lambda x, i: i % 7 == n), "\n")
    figures = F.array(F.struct(F.lit("accuracy").alias("label"), F.col("n_chars").cast("string").alias("value"), F.col("lang").alias("context"), F.lit("results").alias("section")))
    docs = dealt(table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars"))
    docs = docs.withColumn("_lines", F.split(_text(F.col("text")), "\n", -1))  # in a step of its own: split once, not for each section
    return docs.select(F.col("doc_id").alias("paper_id"), *[pick(i).alias(n) for i, n in enumerate(names)], figures.alias("key_figures"))


def _pairs(spark, d):
    n = table(spark, d, "documents")
    return n.where("doc_id > 0").select(F.col("doc_id").alias("pair_id"), (F.col("doc_id") - 1).alias("paper_a"), F.col("doc_id").alias("paper_b"))


def _flat(df):
    return df.withColumn("evidence", F.array_join("evidence", " || "))


def sentences(spark, d):
    return review.sentences(_docs(spark, d))


def score_evidence(spark, d):
    return review.score_evidence(review.sentences(_docs(spark, d))).select("doc_id", "pos", "dimension", "score")


def select_evidence(spark, d):
    return _flat(review.select_evidence(_papers(spark, d)))


def signal_groups(spark, d):
    out = review.signal_groups(_docs(spark, d), {**rv.REPRO_SIGNALS, **rv.FAIRNESS_SIGNALS})
    return out.select("doc_id", F.array_join("groups", ",").alias("groups"))


def _sentence_evidence(spark, d):
    """The sentences of a document as evidence of a dimension."""
    dims = F.array(*map(F.lit, rv.DIMENSIONS))
    docs = _docs(spark, d).select(F.col("doc_id").alias("paper_id"), review.split_sentences(F.col("text")).alias("evidence"))
    return docs.select("paper_id", F.explode(dims).alias("dimension"), "evidence")


def verdicts(spark, d):
    return review.verdicts(_sentence_evidence(spark, d)).select("paper_id", "dimension", "verdict")


def enforce_vocab(spark, d):
    v = _sentence_evidence(spark, d).select("paper_id", "dimension")
    options = [o for os in rv.VERDICTS.values() for o in os]
    free = F.element_at(F.array(*[F.lit(f"The paper: {o[6:40]} maybe") for o in options]), (F.col("paper_id") % len(options) + 1).cast("int"))
    return review.enforce_vocab(v.withColumn("verdict", free))


def cap_confidence(spark, d):
    e = review.sentences(_docs(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n"))
    p = _docs(spark, d).join(e, "doc_id").select("doc_id", review.split_sentences(F.col("text")).alias("evidence"),
                                                 F.when(F.col("n") % 3 == 0, "HIGH").when(F.col("n") % 3 == 1, " medium").otherwise("sure").alias("confidence"))
    return review.cap_confidence(p).select("doc_id", "confidence")


def _profiles(spark, d):
    return review.paper_profiles(_papers(spark, d))


def paper_profiles(spark, d):
    return _flat(_profiles(spark, d))


def compare_profiles(spark, d):
    return _flat(review.compare_profiles(_pairs(spark, d), _profiles(spark, d)))


def consistent_evidence(spark, d):
    e = _papers(spark, d).select(
        "paper_id",
        F.array(F.lit("The method was not evaluated on the glue tasks"), F.concat(F.lit("It reaches 80 accuracy on "), F.when(F.col("paper_id") % 2 == 0, "glue").otherwise("squad")),
                F.col("abstract")).alias("evidence"),
    )
    return _flat(review.consistent_evidence(e))


def incomplete_papers(spark, d):
    p = _sentence_evidence(spark, d).select("paper_id", "dimension").where("(paper_id % 3 <> 0) or dimension <> 'novelty'")
    return review.incomplete_papers(p).select("paper_id", F.array_join("missing", ",").alias("missing"))


def comparison_markdown(spark, d):
    return review.comparison_markdown(review.compare_profiles(_pairs(spark, d), _profiles(spark, d)))


def normalize_assessments(spark, d):
    p = _profiles(spark, d)
    written = p.select(
        "paper_id", "dimension", F.concat(F.lit("I think: "), F.lower("verdict")).alias("verdict"),
        F.when(F.col("paper_id") % 2 == 0, F.lit("A thorough analysis")).otherwise(F.col("rationale")).alias("rationale"),
        F.concat("evidence", F.array(F.lit("a thorough analysis of it"))).alias("evidence"), F.when(F.col("paper_id") % 3 == 0, "high").otherwise("medium").alias("confidence"),
    )
    return _flat(review.normalize_assessments(written, review.select_evidence(_papers(spark, d), 4), _papers(spark, d)))


def normalize_pairwise(spark, d):
    profiles = cut_lineage(_profiles(spark, d))
    c = review.compare_profiles(_pairs(spark, d), profiles)
    raw = c.where("pair_id % 3 <> 0").select(
        "pair_id", F.lit(0).alias("pos"), F.upper("dimension").alias("dimension"),
        F.when(F.col("pair_id") % 2 == 0, "Paper A appears stronger here").otherwise("Both are similar").alias("judgement"), F.lit("As written.").alias("rationale"), "evidence",
    )
    return _flat(review.normalize_pairwise(raw, _pairs(spark, d), profiles))


QUERIES = {
    "rev1_sentences": sentences,
    "rev2_score_evidence": score_evidence,
    "rev3_select_evidence": select_evidence,
    "rev4_signal_groups": signal_groups,
    "rev5_verdicts": verdicts,
    "rev6_enforce_vocab": enforce_vocab,
    "rev7_cap_confidence": cap_confidence,
    "rev8_paper_profiles": paper_profiles,
    "rev9_compare_profiles": compare_profiles,
    "rev10_consistent_evidence": consistent_evidence,
    "rev10_incomplete_papers": incomplete_papers,
    "rev11_comparison_markdown": comparison_markdown,
    "rev12_normalize_assessments": normalize_assessments,
    "rev13_normalize_pairwise": normalize_pairwise,
}

_SENT = f"""l as (select doc_id, unnest(string_split({_SQL_TEXT}, chr(10))) as line, generate_subscripts(string_split({_SQL_TEXT}, chr(10)), 1) as ln from documents),
  p as (select doc_id, ln, unnest(string_split(regexp_replace(b, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) as s, generate_subscripts(string_split(regexp_replace(b, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) as k
    from (select doc_id, ln, {dv.sql_squeeze('line')} as b from l) where b <> ''),
  sent as (select doc_id, (row_number() over (partition by doc_id order by ln, k) - 1)::int as pos, {dv.sql_strip('s')} as sentence from p where {dv.sql_strip('s')} <> '')"""


def _any(words, x="low"):
    return "(" + " or ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _n(words, x="low"):
    return "(" + " + ".join(f"contains({x}, '{w}')::int" for w in words) + ")"


def _sql_score(d: str) -> str:
    s = f"(length(sentence) - length(regexp_replace(sentence, '\\d', '', 'g'))) * 4 + {_n(rv.KEYWORDS[d])} * 3 + contains(sentence, '%')::int * 2 + {_any(['not ', 'only ', 'missing', 'limited', 'unclear'])}::int * 2 + (length(sentence) > 40)::int"
    if d in rv.REQUIRED:
        s += f" - (not {_any(rv.REQUIRED[d])})::int * 6"
    if d in ("threats_to_validity", "applicability"):
        s += f" - regexp_matches(sentence, '{rv.ARCHITECTURE_NOISE}')::int * 6"
    if d == "applicability":
        s += f" - regexp_matches(sentence, '{rv.APPLICABILITY_NOISE}')::int * 6"
    if d == "reproducibility":
        s += f" - (regexp_matches(sentence, '{rv.RESULT_NOISE}') and not {_any(rv.SETUP_WORDS)})::int * 12 - ({_any(rv.RESULT_WORDS)} and not {_any(rv.SETUP_WORDS)})::int * 15"
    return f"({s})::int"


_J = f"j as (select d.doc_id as paper_id, coalesce(string_agg(lower(sentence), ' ' order by pos), '') as low, count(pos) as n from documents d left join sent using (doc_id) group by 1)"
_V = {d: list(v) for d, v in rv.VERDICTS.items()}
_VERDICT = {
    "strengths": f"case when {_n(rv.STRENGTH_WORDS)} >= 2 or regexp_matches(low, '\\d[\\d.]*\\s*(%|pp|point|score)') then '{_V['strengths'][1]}' else '{_V['strengths'][2]}' end",
    "weaknesses": f"case when {_any(rv.WEAKNESS_WORDS)} then '{_V['weaknesses'][1]}' else '{rv.NOT_ENOUGH}' end",
    "novelty": f"case when {_any(rv.FOUNDATIONAL_WORDS)} then '{_V['novelty'][0]}' when {_any(rv.EFFICIENCY_WORDS)} then '{_V['novelty'][1]}' when {_any(rv.EXTENSION_WORDS + rv.WEAK_NOVELTY_WORDS)} then '{_V['novelty'][2]}' else '{rv.NOT_ENOUGH}' end",
    "threats_to_validity": f"case when {_any(rv.THREAT_WORDS)} then '{_V['threats_to_validity'][1]}' else '{rv.NOT_ENOUGH}' end",
    **{d: f"'{_V[d][1]}'" for d in ("assumptions", "reproducibility", "fairness_of_comparison", "applicability")},
}
_SIGNALS = {**rv.REPRO_SIGNALS, **rv.FAIRNESS_SIGNALS}

ORACLES = {
    "rev1_sentences": f"with {_SENT} select doc_id, pos, sentence from sent",
    "rev2_score_evidence": f"with {_SENT}, x as (select *, lower(sentence) as low from sent) " + " union all ".join(f"select doc_id, pos, '{d}' as dimension, {_sql_score(d)} as score from x" for d in rv.DIMENSIONS),
    "rev4_signal_groups": f"""with s as (select doc_id, unnest(string_split_regex(regexp_replace(lower({_SQL_TEXT}), '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n')) as low from documents),
      ok as (select * from s where not regexp_matches(low, '{rv.NEGATION}')), g as (select doc_id, {', '.join(f'bool_or({_any(ks)}) as g{i}' for i, ks in enumerate(_SIGNALS.values()))} from ok group by 1)
      select doc_id, coalesce(concat_ws(',', {', '.join(f"case when g{i} then '{n}' end" for i, n in enumerate(_SIGNALS))}), '') as groups from documents left join g using (doc_id)""",
    "rev5_verdicts": f"with {_SENT}, {_J} " + " union all ".join(f"select paper_id, '{d}' as dimension, case when n = 0 then '{rv.NOT_ENOUGH}' else {v} end as verdict from j" for d, v in _VERDICT.items()),
    "rev10_incomplete_papers": "select doc_id as paper_id, 'novelty' as missing from documents where doc_id % 3 = 0",
}
