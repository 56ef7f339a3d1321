"""Checks of answers against their sources, as columns on a table of responses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions import fixed_values as fv
from litmill.functions.text import WORD, contains_any, let, strip
from litmill.operators.history import nearest_element
from litmill.operators.lines import element_refs

_KINDS = list(fv.ELEMENT_REFERENCE)


def relevance(queries: DataFrame, results: DataFrame, chunks: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, relevance): share of the 3+ letter words of a question found in the text retrieved for it; 0 without results.

    Words are looked up chunk by chunk and the hits united, so retrieved texts are never put together.
    """
    found = F.regexp_extract_all(F.lower("query"), F.lit(rf"(?<![{WORD}])([a-z]{{3,}})(?![{WORD}])"), F.lit(1))
    terms = queries.select(key, F.array_distinct(found).alias("terms"))
    low = chunks.select("chunk_id", F.lower("text").alias("low"))
    hits = (
        results.select(key, "chunk_id").join(terms, key).join(low, "chunk_id")
        .select(key, F.explode(F.filter("terms", lambda t: F.contains(F.col("low"), t))).alias("t"))
        .groupBy(key).agg(F.count_distinct("t").alias("hits"))
    )
    share = F.coalesce("hits", F.lit(0)) / F.greatest(F.size("terms"), F.lit(1))
    return terms.join(hits, key, "left").select(key, share.alias("relevance"))


def invalid_refs(responses: DataFrame, registry: DataFrame, key: str = "response_id") -> DataFrame:
    """(key, element_type, number): references to elements that the document does not have."""
    refs = element_refs(responses, key).join(responses.select(key, "doc_id"), key)
    known = registry.select("doc_id", "element_type", "number").distinct()
    return refs.join(known, ["doc_id", "element_type", "number"], "left_anti").select(key, "element_type", "number")


def correct_refs(responses: DataFrame, registry: DataFrame, key: str = "response_id") -> DataFrame:
    """(key, text, n_changed): references moved to the nearest element, or marked as not found.

    The text is cut at its references; only the distinct wrong numbers are looked up and come back as one
    small map per response.
    """
    wrong = invalid_refs(responses, registry, key).join(responses.select(key, "doc_id"), key)
    near = nearest_element(wrong, registry)
    name = F.initcap("element_type")
    fixed = F.when(F.col("nearest").isNotNull(), F.concat(name, F.lit(" "), F.col("nearest").cast("string"))).otherwise(
        F.concat(F.lit("["), name, F.lit(" NOT FOUND]"))
    )
    entry = F.struct(F.concat_ws(" ", "element_type", F.col("number").cast("string")).alias("k"), fixed.alias("v"))
    fixes = near.groupBy(key).agg(F.map_from_entries(F.collect_set(entry)).alias("fixes"))
    one = "|".join(p.replace(r"(\d+)", r"\d+") for p in fv.ELEMENT_REFERENCE.values())

    def fix(part: Column) -> Column:
        low = F.lower(part)
        out = part
        for kind, p in fv.ELEMENT_REFERENCE.items():
            n = F.regexp_extract(low, p, 1)
            found = F.element_at(F.col("fixes"), F.concat(F.lit(f"{kind} "), n.cast("bigint").cast("string")))
            out = F.when(low.rlike(rf"^(?:{p})$"), F.coalesce(found, part)).otherwise(out)
        return out

    rows = responses.select(key, "text").join(fixes, key, "left")
    seps = F.split("text", f"(?i){one}", -1)
    marks = F.regexp_extract_all("text", F.lit(f"(?i)({one})"), F.lit(0))
    parts = let(marks, lambda m: F.transform(seps, lambda s, i: F.concat(s, F.coalesce(fix(F.get(m, i)), F.lit("")))))
    text = F.when(F.col("fixes").isNotNull(), F.array_join(parts, "")).otherwise(F.col("text"))
    return rows.select(key, text.alias("text"), F.coalesce(F.size("fixes"), F.lit(0)).alias("n_wrong"))


def _mentions(kind: str) -> Column:
    return F.lower("text").rlike(fv.ELEMENT_REFERENCE[kind])


def type_conflicts(responses: DataFrame) -> DataFrame:
    """Adds ``type_conflicts``: other element types an answer refers to when the question is about one type."""
    flags = [
        F.when((F.col("query_type") == asked) & _mentions(other), F.lit(other)) for asked in _KINDS for other in _KINDS if asked != other
    ]
    return responses.withColumn("type_conflicts", F.filter(F.array(*flags), lambda x: x.isNotNull()))


def numbers_of(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b(\d+\.?\d*)\b"), F.lit(1))


def unsupported_numbers(responses: DataFrame, sources: DataFrame, key: str = "response_id") -> DataFrame:
    """(key, unsupported, hedges, flags): the numbers of an answer longer than two characters that no
    source has, and hedging phrases; more than three or two of them raise a flag.

    sources: key, text. Only numbers are gathered per answer, distinct, and only those the answer has.
    """
    asked = responses.select(key, numbers_of(F.col("text")).alias("nums"), F.lower("text").alias("low"))
    wanted = asked.select(key, F.explode(F.array_distinct("nums")).alias("n"))
    have = sources.select(key, F.explode(F.array_distinct(numbers_of(F.col("text")))).alias("n")).distinct()
    known = wanted.join(have, [key, "n"], "left_semi").groupBy(key).agg(F.collect_set("n").alias("known"))
    rows = asked.join(known, key, "left")
    seen = F.coalesce("known", F.array().cast("array<string>"))
    bad = F.filter("nums", lambda n: ~F.array_contains(seen, n) & (F.length(n) > 2))
    hedges = F.filter(F.array(*map(F.lit, fv.HEDGES)), lambda h: F.contains(F.col("low"), h))
    out = rows.select(key, bad.alias("unsupported"), hedges.alias("hedges"))
    flags = (F.size("hedges") > 2).cast("int") + (F.size("unsupported") > 3).cast("int")
    return out.withColumn("flags", flags)


def completeness(responses: DataFrame) -> DataFrame:
    """Adds ``incomplete``: reasons why an answer misses something (length, the element asked for, a list)."""
    t = F.col("text")
    number = F.col("target_number").cast("string")
    reasons = F.array(
        F.when(F.length(strip(t)) < 50, F.lit("too short")),
        F.when((F.col("query_type") == "specific_element") & ~F.contains(t, F.coalesce(number, F.lit("None"))), F.lit("element not mentioned")),
        F.when((F.col("query_type") == "list_all") & ~contains_any(t, fv.LIST_MARKS), F.lit("no list")),
    )
    return responses.withColumn("incomplete", F.filter(reasons, lambda x: x.isNotNull()))


def repetition(responses: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``repetition_rate`` of sentences over 10 characters and ``repetitive`` (more than 5 and over 30 % repeated)."""
    parts = F.filter(F.transform(F.split(F.col(text), "[.!?]+", -1), lambda s: F.lower(strip(s))), lambda s: F.length(s) > 10)

    def rate(s: Column) -> Column:
        n, u = F.size(s), F.size(F.array_distinct(s))
        return F.struct(
            F.when(n > 0, 1 - u / n).otherwise(0.0).alias("repetition_rate"), ((n > 5) & (u < n * 0.7)).alias("repetitive")
        )

    return responses.withColumn("_r", let(parts, rate)).select(*responses.columns, "_r.*")


def answer_flags(responses: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``looks_broken`` and ``looks_like_refusal``."""
    t = F.coalesce(F.col(text), F.lit(""))
    broken = reduce(lambda a, p: a | t.rlike(p), fv.BROKEN_ANSWER, t == "")
    refusal = (t == "") | F.contains(F.lower(t), F.lit("the document does not contain this information"))
    return responses.withColumn("looks_broken", broken).withColumn("looks_like_refusal", refusal)


def validate(responses: DataFrame, registry: DataFrame, sources: DataFrame, relevance_rows: DataFrame, level: str = "strict") -> DataFrame:
    """(response_id, confidence, n_issues, passed): all checks as one confidence and verdict.

    responses: response_id, doc_id, query_type, target_number, text; sources: response_id, text;
    relevance_rows: response_id, relevance.
    """
    need, most, least = fv.LEVELS[level]
    key = "response_id"
    wrong = invalid_refs(responses, registry).groupBy(key).agg(F.count("*").alias("n_wrong"))
    own = repetition(completeness(type_conflicts(responses)))
    rows = (
        own.join(wrong, key, "left")
        .join(unsupported_numbers(responses, sources), key)
        .join(relevance_rows, key, "left")
        .select(
            key,
            F.coalesce("n_wrong", F.lit(0)).alias("refs"),
            F.size("type_conflicts").alias("types"),
            F.col("flags").alias("unsupported"),
            F.size("incomplete").alias("complete"),
            F.col("repetitive").cast("int").alias("repetition"),
            (F.coalesce("relevance", F.lit(0.0)) < least).cast("int").alias("relevance"),
        )
    )
    confidence = reduce(lambda a, c: a * F.when(F.col(c) > 0, F.lit(fv.CONFIDENCE[c])).otherwise(1.0), fv.CONFIDENCE, F.lit(1.0))
    issues = reduce(lambda a, c: a + F.col(c), fv.CONFIDENCE, F.lit(0))
    out = rows.withColumn("confidence", confidence).withColumn("n_issues", issues.cast("bigint"))
    passed = (F.col("confidence") >= need) & (F.col("n_issues") <= most) & (F.col("relevance") == 0)
    return out.select(key, "confidence", "n_issues", passed.alias("passed"))
