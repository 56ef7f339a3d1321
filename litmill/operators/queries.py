"""Operators on tables of user questions: classes, variants, expansion, decomposition, metadata answers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions import fixed_values as fv
from litmill.functions.skew import top_k
from litmill.functions.text import WORD, contains_any, count_contained, first_of, first_per_key, let, squeeze, strip, words
from litmill.operators.lexical import focus_term_of, is_definition, is_explanation, is_limitations, is_summary
from litmill.session import cut_lineage


def _any_match(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, p: a | c.rlike(p), patterns, F.lit(False))


def _strings() -> Column:
    return F.array().cast("array<string>")


# ---- classes ------------------------------------------------------------------------------------


def classify_queries(queries: DataFrame, text: str = "query") -> DataFrame:
    """Adds query_type, target_type, target_number, target_numbers and confidence; rules in order, then keyword votes."""
    q = F.lower(strip(F.coalesce(F.col(text), F.lit(""))))
    # (kind, confidence, fixed type, pattern) in order; groups of the pattern give type and numbers.
    rules = [("cross_reference", 0.9, None, p) for p in fv.CROSS_REFERENCE_PATTERNS]
    rules += [("comparison", 0.95, None, p) for p in fv.COMPARISON_PATTERNS]
    rules += [("list_all", 1.0, None, p) for p in fv.LIST_ALL_PATTERNS]
    rules += [("specific_element", 1.0, kind, p) for kind, ps in fv.SPECIFIC_PATTERNS.items() for p in ps]
    first = F.coalesce(*[F.when(q.rlike(r[3]), F.lit(i)) for i, r in enumerate(rules)], F.lit(-1))
    votes = {kind: count_contained(q, ws) for kind, ws in fv.TYPE_KEYWORDS.items()}
    most = F.greatest(*votes.values())
    voted = F.coalesce(*[F.when((most > 0) & (v == most), F.lit(kind)) for kind, v in votes.items()])

    def pick(rule: Column, group: int, kinds: tuple[str, ...]) -> Column:
        """A group of the pattern that matched, for rules of some kinds."""
        found = [F.when(rule == i, F.regexp_extract(q, r[3], group)) for i, r in enumerate(rules) if r[0] in kinds]
        return F.coalesce(*found)

    def fields(rule: Column) -> Column:
        at = lambda xs: F.get(F.array(*[F.lit(x).cast("string") for x in xs]), rule)
        by_rule = F.get(F.array(*[F.lit(r[1]) for r in rules]), rule)
        by_vote = F.when(q == "", 0.5).when(most == 0, 0.7).otherwise(0.8)
        numbers = F.array(pick(rule, 2, ("comparison",)).cast("bigint"), pick(rule, 3, ("comparison",)).cast("bigint"))
        return F.struct(
            F.when(rule >= 0, at([r[0] for r in rules])).otherwise(F.coalesce(voted, F.lit("general"))).alias("query_type"),
            F.when(rule >= 0, F.coalesce(at([r[2] for r in rules]), pick(rule, 1, ("comparison", "list_all")))).otherwise(voted).alias("target_type"),
            pick(rule, 1, ("specific_element",)).cast("bigint").alias("target_number"),
            F.when(numbers[0].isNotNull(), numbers).alias("target_numbers"),
            F.when(rule >= 0, by_rule).otherwise(by_vote).alias("confidence"),
        )

    return queries.withColumn("_i", let(first, fields)).select(*queries.columns, "_i.*")


def query_flags(queries: DataFrame, text: str = "query") -> DataFrame:
    """Adds flags for lists, summaries, limitations, definitions, explanations and metadata, the mode and the answer mode."""
    c = F.col(text)
    q = F.lower(strip(c))
    lists = {kind: contains_any(q, phrases) for kind, phrases in fv.LIST_PHRASES.items()}
    count = contains_any(q, fv.COUNT_WORDS) & contains_any(q, fv.ELEMENT_TYPES)
    equation = contains_any(q, fv.ANSWER_EQUATION_WORDS) | q.rlike(fv.ANSWER_EQUATION_NUMBER)
    answer_mode = (
        F.when(count, "count")
        .when(lists["equation"], "all_equations")
        .when(lists["table"], "all_tables")
        .when(lists["figure"], "all_figures")
        .when(equation, "specific_equation")
        .when(contains_any(q, fv.TABLE_WORDS), "table")
        .when(contains_any(q, fv.FIGURE_QUERY_WORDS), "figure")
        .otherwise("general")
    )
    mode = F.when(contains_any(q, fv.MODE_EXPLANATION_WORDS), "explanation").when(contains_any(q, fv.ANALYSIS_WORDS), "analysis").otherwise("standard")
    return queries.withColumns(
        {
            "lists_all": lists["equation"] | lists["table"] | lists["figure"],
            "asks_summary": is_summary(c),
            "asks_limitations": is_limitations(c),
            "asks_definition": is_definition(c),
            "asks_explanation": is_explanation(c),
            "asks_metadata": contains_any(q, fv.METADATA_WORDS),
            "mode": mode,
            "answer_mode": answer_mode,
        }
    )


# ---- terms ------------------------------------------------------------------------------------------


def seed_terms(queries: DataFrame, key: str = "query_id", text: str = "query", limit: int | None = None) -> DataFrame:
    """(key, pos, term): quoted phrases, capitalised runs, content words; distinct in any case, in this order."""
    q = F.col(text)
    quoted = F.regexp_extract_all(q, F.lit(r'"([^"]+)"'), F.lit(1))
    runs = F.regexp_extract_all(q, F.lit(r"\b([A-Z][A-Za-z0-9\-]+(?:\s+[A-Z][A-Za-z0-9\-]+)*)\b"), F.lit(1))
    plain = F.regexp_extract_all(q, F.lit(r"\b([a-zA-Z][a-zA-Z0-9\-]{3,})\b"), F.lit(1))
    content = F.filter(plain, lambda t: ~F.lower(t).isin(fv.SEED_STOP_WORDS))
    terms = first_of(first_per_key(F.concat(quoted, runs, content), lambda t: F.lower(t), lambda t: F.lit(False)), limit)
    return queries.select(key, F.posexplode(terms).alias("pos", "term"))


def keyword_query(sentences: DataFrame, text: str = "text", n: int = 6) -> DataFrame:
    """Adds ``keywords``: the first words of a sentence without punctuation and stop words."""
    plain = words(F.regexp_replace(F.col(text), rf"[^{WORD}\s]", ""))
    return sentences.withColumn(
        "keywords",
        F.array_join(F.slice(F.filter(plain, lambda w: ~F.lower(w).isin(fv.KEYWORD_QUERY_STOP_WORDS)), 1, n), " "),
    )


# ---- variants and expansion ----------------------------------------------------------------------------


def _distinct_any_case(items: Column) -> Column:
    return first_per_key(items, lambda x: F.lower(strip(x)), lambda x: F.lit(False))


def query_variants(queries: DataFrame, key: str = "query_id", text: str = "query", limit: int | None = None) -> DataFrame:
    """(key, variant_no, query): the question, then searches for summaries, limitations and definitions."""
    q = strip(F.coalesce(F.col(text), F.lit("")))
    focus = squeeze(focus_term_of(q))
    lits = lambda xs: F.array(*map(F.lit, xs))
    items = F.concat(
        F.array(q),
        F.when(is_summary(q), lits(fv.SUMMARY_VARIANTS)).otherwise(_strings()),
        F.when(is_limitations(q), lits(fv.LIMITATION_VARIANTS)).otherwise(_strings()),
        F.when(
            is_definition(q) & (focus != ""), F.array(focus, F.concat(focus, F.lit(" definition")), F.concat(F.lit("what is "), focus))
        ).otherwise(_strings()),
    )
    kept = first_of(_distinct_any_case(F.filter(items, lambda x: x != "")), limit)
    return queries.select(key, F.posexplode(kept).alias("variant_no", "query"))


def _filled(template: str, value: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def _swap_first(q: Column, old: str, new: str) -> Column:
    return F.regexp_replace(q, rf"(?is)^(.*?)\b{old}\b", f"$1{new}")


def reformulated(query: Column, n: int) -> Column:
    base = F.rtrim(strip(query), F.lit("?"))
    low = F.lower(query)
    question = reduce(lambda a, w: a | low.startswith(w), fv.QUESTION_STARTS, F.lit(False)) | query.contains("?")
    asked = F.array(*[F.when(low.contains(old), _swap_first(low, old, new)) for old, new in fv.QUESTION_SWAPS])
    plain = F.array(*[_filled(t, base) for t in fv.QUESTION_TEMPLATES])
    return F.slice(F.when(question, F.filter(asked, lambda x: x.isNotNull())).otherwise(plain), 1, n)


def with_synonyms(query: Column, n: int) -> Column:
    low = F.lower(query)
    swaps = [F.when(low.contains(term), _swap_first(low, term, s)) for term, syns in fv.SYNONYMS.items() for s in syns]
    changed = F.filter(F.array(*swaps), lambda x: x.isNotNull() & (x != low))
    return F.slice(F.when(F.size(changed) > 0, changed).otherwise(F.array(query)), 1, n)


def with_context(query: Column, n: int) -> Column:
    return F.slice(F.array(*[_filled(t, strip(query)) for t in fv.CONTEXT_TEMPLATES]), 1, n)


def generalised(query: Column, n: int) -> Column:
    found = F.regexp_extract_all(F.lower(query), F.lit(rf"(?<![{WORD}])([a-z]+)(?![{WORD}])"), F.lit(1))
    concepts = F.filter(found, lambda w: ~w.isin(fv.CONCEPT_STOP_WORDS) & (F.length(w) > 3))
    pairs = F.zip_with(
        F.slice(concepts, 1, F.greatest(F.size(concepts) - 1, F.lit(0))),
        F.slice(concepts, 2, F.greatest(F.size(concepts), F.lit(1))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    top = F.concat(F.filter(pairs, lambda p: p.isNotNull()), concepts)
    general = F.flatten(F.transform(top, lambda c: F.array(*[_filled(t, c) for t in fv.GENERAL_TEMPLATES])))
    ws = words(query)
    half = F.when(F.size(ws) > 3, F.array(F.array_join(F.slice(ws, F.lit(1), F.floor(F.size(ws) / 2).cast("int")), " "))).otherwise(_strings())
    return F.slice(F.when(F.size(top) > 0, general).otherwise(half), 1, n)


def mixed(query: Column, n: int) -> Column:
    a, b, c = reformulated(query, 2), with_synonyms(query, 2), with_context(query, 1)
    ab = F.concat(a, b)
    all_ = F.when(F.size(a) >= n, a).when(F.size(ab) >= n, ab).otherwise(F.concat(ab, c))
    return F.slice(_distinct_any_case(all_), 1, n)


STRATEGIES = {
    "question_reformulation": reformulated,
    "synonym_injection": with_synonyms,
    "context_addition": with_context,
    "specificity_reduction": generalised,
    "multi_strategy": mixed,
}


def expand_queries(queries: DataFrame, strategy: str = "multi_strategy", n: int = 5, key: str = "query_id", text: str = "query") -> DataFrame:
    """(key, pos, expansion) by one strategy."""
    return queries.select(key, F.posexplode(STRATEGIES[strategy](F.col(text), n)).alias("pos", "expansion"))


def expand_by_scores(queries: DataFrame, scores: DataFrame, threshold: float = 0.5, key: str = "query_id") -> DataFrame:
    """(key, strategy, pos, expansion): the lower the average retrieval score, the wider the expansion."""
    avg = scores.groupBy(key).agg(F.avg("score").alias("avg_score"))
    q = F.col("query")
    s = F.coalesce("avg_score", F.lit(0.0))
    chosen = (
        F.when(s < threshold * 0.5, F.struct(F.lit("specificity_reduction").alias("strategy"), generalised(q, 5).alias("x")))
        .when(s < threshold, F.struct(F.lit("multi_strategy").alias("strategy"), mixed(q, 4).alias("x")))
        .otherwise(F.struct(F.lit("synonym_injection").alias("strategy"), with_synonyms(q, 3).alias("x")))
    )
    rows = queries.join(avg, key, "left").withColumn("c", chosen)
    return rows.select(key, F.col("c.strategy").alias("strategy"), F.posexplode("c.x").alias("pos", "expansion"))


def adaptive_expand(queries: DataFrame, attempts: DataFrame, similar: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, strategy, pos, expansion) by attempt number and last score; from the third attempt on, expansions
    that worked for similar questions. attempts: key, attempt, score. similar: key, expansion, score (best first by score).
    """
    best = similar.groupBy(key).agg(
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "expansion"))), lambda x: x["expansion"]), 1, 3).alias("past")
    )
    q, a, s = F.col("query"), F.col("attempt"), F.col("score")
    plan = lambda name, x: F.struct(F.lit(name).alias("strategy"), x.alias("x"))
    chosen = (
        F.when((a == 1) & (s < 0.3), plan("multi_strategy", mixed(q, 5)))
        .when((a == 1) & (s < 0.6), plan("synonym_injection", with_synonyms(q, 3)))
        .when(a == 1, plan("question_reformulation", reformulated(q, 2)))
        .when(a == 2, plan("specificity_reduction", generalised(q, 4)))
        .when(F.col("past").isNotNull(), plan("similar_queries", F.col("past")))
        .otherwise(plan("context_addition", with_context(q, 3)))
    )
    rows = queries.join(attempts, key).join(best, key, "left").withColumn("c", chosen)
    return rows.select(key, F.col("c.strategy").alias("strategy"), F.posexplode("c.x").alias("pos", "expansion"))


SKETCH = 4  # words of 64 bits
SHARE = 2000  # texts that share a rare word in one join group


def _sketch(ws: Column) -> list[Column]:
    """A bit for each word of a set, in SKETCH longs: two sets share at most the words of the one whose bits the other has."""
    places = F.transform(ws, lambda w: F.pmod(F.xxhash64(w), F.lit(64 * SKETCH)).cast("int"))
    one = F.lit(1).cast("long")

    def bits(i: int) -> Column:
        own = F.filter(places, lambda h: F.floor(h / 64) == i)
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, h: a.bitwiseOR(F.call_function("shiftleft", one, h % 64)))

    return [bits(i).alias(f"s{i}") for i in range(SKETCH)]


def close_sets(asked: DataFrame, past: DataFrame, threshold: float) -> DataFrame:
    """(a, b): candidates for pairs of sets that share more than ``threshold`` of the larger one. Both: id (unique), w (distinct words).

    Two such sets share one of their rarest words, at places that leave room for the overlap; of the pairs that do, only those go
    further whose sketches allow it. A word that many sets hold is dealt to shards.
    """
    usage = (
        past.select(F.explode("w").alias("word")).unionByName(asked.select(F.explode("w").alias("word")))
        .groupBy("word").agg(F.count("*").alias("n"))
    )

    def rare(side: DataFrame, name: str) -> DataFrame:
        """The rarest words of each set that any sufficient overlap must touch, with size, place and sketch."""
        ordered = (
            side.select("id", F.explode("w").alias("word")).join(usage, "word")
            .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("o"))
        )
        needed = F.floor(F.size("o") * threshold).cast("int") + 1
        prefix = F.slice("o", F.lit(1), F.greatest(F.size("o") - needed + 1, F.lit(0)))
        rows = ordered.join(side.select("id", *_sketch(F.col("w"))), "id")
        rows = rows.select("id", F.size("o").alias("size"), F.posexplode(prefix).alias("at", "x"), *[f"s{i}" for i in range(SKETCH)])
        shards = F.floor(F.col("x.n") / SHARE) + 1
        shard = F.explode(F.sequence(F.lit(0).cast("long"), shards - 1)) if name == "a" else F.pmod(F.xxhash64("id"), shards)
        return rows.select(F.col("x.word").alias("word"), shard.alias("shard"), *[F.col(c).alias(f"{name}_{c}") for c in ("id", "size", "at", *[f"s{i}" for i in range(SKETCH)])])

    pairs = rare(asked, "a").join(rare(past, "b"), ["word", "shard"])
    least = F.greatest("a_size", "b_size") * threshold - 1e-6
    missing = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a_s{i}").bitwiseAND(F.bitwise_not(f"b_s{i}"))) for i in range(SKETCH)])
    room = F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at"))
    return pairs.where((room > least) & (F.col("a_size") - missing > least)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


def similar_queries(queries: DataFrame, history: DataFrame, threshold: float = 0.5, keep: int = 10, key: str = "query_id") -> DataFrame:
    """(key, past_query, expansion, similarity, score): successful expansions of past questions whose words
    overlap more than ``threshold`` of the larger word set; the ``keep`` best per question.

    history: past_query, expansion, score. Equal texts are merged first. Pairs are numbers until they are known to be close
    (``close_sets``): frequent words never make pairs, and texts are never multiplied.
    """
    best = history.groupBy("past_query").agg(F.max_by(F.struct("expansion", "score"), F.struct("score", "expansion")).alias("b"))
    number = F.monotonically_increasing_id().alias("id")
    past = cut_lineage(best.select(number, "past_query", F.array_distinct(words(F.lower("past_query"))).alias("w"), "b.*"))
    asked = cut_lineage(queries.select("query").distinct().select(number, "query", F.array_distinct(words(F.lower("query"))).alias("w")))
    pairs = close_sets(asked.select("id", "w"), past.select("id", "w"), threshold)
    sized = pairs.join(asked.select(F.col("id").alias("a"), F.col("w").alias("qw")), "a").join(past.select(F.col("id").alias("b"), F.col("w").alias("pw"), "score"), "b")
    similarity = F.size(F.array_intersect("qw", "pw")) / F.greatest(F.size("qw"), F.size("pw"))
    close = sized.select("a", "b", "score", similarity.alias("similarity")).where(F.col("similarity") > threshold)
    close = close.withColumn("score", F.col("score") * F.col("similarity"))
    close = close.join(past.select(F.col("id").alias("b"), "past_query", "expansion"), "b")
    order = [F.round("score", 9).desc(), F.col("past_query")]
    close = top_k(close, ["a"], order, keep).drop("rank").join(asked.select(F.col("id").alias("a"), "query"), "a")
    rows = queries.select(key, "query").join(close.select("query", "past_query", "expansion", "similarity", "score"), "query").drop("query")
    return top_k(rows, [key], order, keep).drop("rank")


# ---- decomposition and fusion ---------------------------------------------------------------------------


def decompose(queries: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    """(key, query_type, is_complex, pos, sub_query, sub_type, priority, dependencies): comparisons, element
    references and sequences become sub-questions; the first rule that matches decides."""
    q = F.lower(strip(F.col(text)))

    def subs(name: str, a: Column, b: Column) -> Column:
        def fill(t: str) -> Column:
            marks = {"{1}": a, "{2}": b, "{q}": F.col(text)}
            return F.concat(*[marks.get(p, F.lit(p)) for p in re.split(r"(\{[12q]\})", t)])

        return F.array(
            *[
                F.struct(
                    fill(t).alias("sub_query"), F.lit(kind).alias("sub_type"), F.lit(prio).alias("priority"),
                    F.array(*map(F.lit, deps)).cast("array<int>").alias("dependencies"),
                )
                for t, kind, prio, deps in fv.SUB_QUESTIONS[name]
            ]
        )

    rules = (
        [(p, t, "compare") for p, t in fv.COMPARATIVE_RULES]
        + [(p, t, t) for p, t in fv.REFERENCE_RULES]
        + [(p, t, "sequence") for p, t in fv.SEQUENTIAL_RULES]
    )
    out = None
    for pattern, kind, name in rules:
        a, b = (strip(F.regexp_extract(q, pattern, g)) for g in (1, 2))
        row = F.struct(F.lit(kind).alias("query_type"), F.lit(True).alias("is_complex"), subs(name, a, b).alias("subs"))
        out = F.when(q.rlike(pattern), row) if out is None else out.when(q.rlike(pattern), row)
    simple = F.struct(F.lit("simple").alias("query_type"), F.lit(False).alias("is_complex"), subs("simple", q, q).alias("subs"))
    rows = queries.select(key, out.otherwise(simple).alias("d"))
    return rows.select(key, "d.query_type", "d.is_complex", F.posexplode("d.subs").alias("pos", "s")).select(
        key, "query_type", "is_complex", "pos", "s.*"
    )


def fuse_answers(sub_answers: DataFrame, method: str = "concatenate", key: str = "query_id") -> DataFrame:
    """(key, answer) from (key, pos, sub_type, answer); a question has a handful of sub-answers.

    "concatenate" puts a heading before each retrieved part; "weighted" puts retrieved parts first, then analysis.
    """
    rows = sub_answers.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "sub_type", "answer"))).alias("s"))
    analysis = lambda x: x["sub_type"] == "synthesis"
    if method == "weighted":
        got = F.transform(F.filter("s", lambda x: ~analysis(x)), lambda x: x["answer"])
        thought = F.transform(F.filter("s", analysis), lambda x: x["answer"])
        part = lambda title, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"**{title}:**\n"), F.array_join(xs, "\n\n")))
        return rows.select(key, F.concat_ws("\n\n", part("Retrieved Information", got), part("Analysis", thought)).alias("answer"))
    blocks = F.transform(
        "s",
        lambda x, i: F.when(analysis(x), x["answer"]).otherwise(
            F.concat(F.lit("**Part "), (i + 1).cast("string"), F.lit(" ("), x["sub_type"], F.lit("):**\n"), x["answer"])
        ),
    )
    return rows.select(key, F.array_join(blocks, "\n\n").alias("answer"))


# ---- answers from metadata ---------------------------------------------------------------------------------


def metadata_answers(queries: DataFrame, metadata: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, field, answer) for questions about title, authors, affiliations, year, abstract or arXiv id.

    queries: key, doc_id, query; metadata: doc_id, title, authors, affiliations, year, abstract, arxiv_id
    (lists as arrays). An empty field answers that the document does not contain it.
    """
    q = F.lower(F.col("query"))
    field = (
        F.when(q.contains("title") & (q.contains("paper") | q.contains("document") | (F.trim(q) == "title")), "title")
        .when(contains_any(q, ["who wrote", "authors", "author list", "written by", "main authors"]), "authors")
        .when(q.contains("affiliation"), "affiliations")
        .when(contains_any(q, ["published", "publication year", "when was", "year"]), "year")
        .when(q.contains("abstract"), "abstract")
        .when(q.contains("arxiv") & contains_any(q, ["identifier", "id", "number"]), "arxiv_id")
    )
    asked = queries.select(key, "doc_id", field.alias("field")).where("field is not null")
    flat = metadata.select(
        "doc_id", "title", F.array_join("authors", ", ").alias("authors"), F.array_join("affiliations", "; ").alias("affiliations"),
        "year", "abstract", "arxiv_id",
    )
    value = F.coalesce(*[F.when(F.col("field") == f, F.col(f)) for f in ("title", "authors", "affiliations", "year", "abstract", "arxiv_id")], F.lit(""))
    rows = asked.join(flat, "doc_id", "left").withColumn("value", value)
    answer = F.when(F.col("value") != "", F.concat("value", F.lit("\n\n(Source: Page 1)"))).otherwise(fv.NOT_CONTAINED)
    return rows.select(key, "field", answer.alias("answer"))
