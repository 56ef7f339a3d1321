"""Critical review of a corpus: evidence per dimension, verdicts, profiles and comparisons of papers.

A paper's sentences come out of one row, so scoring, cleaning and selecting its evidence are array
expressions in that row. Only the comparison of papers joins, on (paper, dimension).
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litmill.functions import review_values as rv
from litmill.functions.skew import first_rows
from litmill.functions.text import contains_any, count_contained, first_of, let, squeeze, strip, strip_chars, word_array
from litmill.operators import evidence as ev
from litmill.operators.cleaning import sentences_of
from litmill.session import cut_lineage

_NONE = "array<string>"


def _strings() -> Column:
    return F.array().cast(_NONE)


def split_sentences(text: Column) -> Column:
    """Sentences of every line, whitespace squeezed."""
    blocks = F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r", "\n"), "\n", -1), squeeze)
    parts = F.flatten(F.transform(F.filter(blocks, lambda b: b != ""), sentences_of))
    return F.filter(F.transform(parts, strip), lambda s: (s != "") & (s != "Not found"))


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(split_sentences(F.col(text))).alias("pos", "sentence"))


# ---- scores ---------------------------------------------------------------------------------------


@F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _points(lows: pa.Array) -> pa.Array:
    """The points of all sentences of a row, counted a batch of rows at a time."""
    flat = pa.compute.fill_null(lows.flatten(), "")
    width = len(rv.DIMENSIONS)
    points = ev.word_points(flat).ravel()
    ends = lambda n, step: pa.array(np.arange(n + 1, dtype=np.int32) * step)
    each = pa.ListArray.from_arrays(ends(len(flat), width), pa.array(points))
    sizes = pa.compute.fill_null(pa.compute.list_value_length(lows), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), each)


def _common_points(s: Column) -> Column:
    """Digits, marks and length: what counts in every dimension."""
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    digits = F.when(s.rlike(r"\d"), F.length(s) - F.length(F.regexp_replace(s, r"\d", ""))).otherwise(0)
    return digits * 4 + points(s.contains("%"), 2) + points(F.length(s) > 40, 1)


def _noise_points(s: Column, low: Column, dimension: str) -> Column:
    """Penalties for sentences that a pattern finds off the dimension."""
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    out = F.lit(0)
    if dimension in ("threats_to_validity", "applicability"):
        out = out + points(s.rlike(rv.ARCHITECTURE_NOISE), 6)
    if dimension == "applicability":
        out = out + points(s.rlike(rv.APPLICABILITY_NOISE), 6)
    if dimension == "reproducibility":
        out = out + points(s.rlike(rv.RESULT_NOISE) & ~contains_any(low, rv.SETUP_WORDS), 12)
    return out


def score_evidence(sentence_rows: DataFrame, dimensions: list[str] | None = None) -> DataFrame:
    """Every sentence with its score in each dimension: digits, keywords, marks and length, minus penalties for sentences off the
    dimension. One projection and an explode of eight entries; a null sentence has no score."""
    s, at = F.col("sentence"), list(rv.DIMENSIONS).index
    rows = sentence_rows.withColumns({"_low": F.lower(s), "_common": _common_points(s)})
    rows = rows.withColumn("_points", _points(F.array("_low"))[0])
    scores = F.array(
        *[
            F.struct(F.lit(d).alias("dimension"), (F.col("_common") + F.col("_points")[at(d)] - _noise_points(s, F.col("_low"), d)).alias("score"))
            for d in dimensions or rv.DIMENSIONS
        ]
    )
    return rows.withColumn("_d", F.explode(scores)).select(*sentence_rows.columns, "_d.dimension", "_d.score")


# ---- evidence -----------------------------------------------------------------------------------------


def clean_bullet(c: Column) -> Column:
    return strip_chars(F.regexp_replace(squeeze(F.coalesce(c, F.lit(""))), r"^[\-*•]+\s*", ""), " .")


def specific_count(evidence: Column) -> Column:
    """How many items name something concrete (dataset, metric, omission) or pair a number with a unit."""
    return ev.count_specific(evidence)


def _trimmed(t: Column) -> Column:
    """Over 160 characters: cut at the last blank before 157 and an ellipsis."""
    head = F.substring(t, 1, 157)
    cut = F.length(head) - F.instr(F.reverse(head), " ")
    return F.when(F.length(t) > 160, F.concat(F.when(head.contains(" "), F.substring(head, F.lit(1), cut)).otherwise(head), F.lit("…"))).otherwise(t)


def clean_evidence(items: Column, limit: int = 5, trim: bool = False) -> Column:
    """Cleaned, distinct evidence in order: no generic phrases or number dumps, one item per metric value, concrete
    items only when there are any, at most ``limit``. Whole texts, unless ``trim`` asks for 160 characters to show."""
    chosen = ev.clean_lists(items, limit)
    return F.transform(chosen, _trimmed) if trim else chosen


def select_evidence(papers: DataFrame, limit: int = 5, dimensions: list[str] | None = None, trim: bool = False) -> DataFrame:
    """(paper_id, dimension, evidence) of papers given as section columns; other columns are kept.

    Sentences and key figures are scored, filtered and ranked whole: by score, then in section order; with ``trim`` the chosen
    ones come in 160 characters.
    """
    keep = [c for c in papers.columns if c not in (*rv.PAPER_SECTIONS, "key_figures")]
    sections = [c for c in rv.PAPER_SECTIONS if c in papers.columns]
    wanted = list(dimensions or rv.DIMENSIONS)
    figures = []
    if "key_figures" in papers.columns:
        nonempty = lambda c: F.nullif(c, F.lit(""))
        shown = lambda f: F.concat_ws(" | ", F.concat(f["label"], F.lit(": "), f["value"]), nonempty(f["context"]), nonempty(f["section"]))
        figures = [F.transform("key_figures", shown), F.transform("key_figures", lambda f: F.lower(squeeze(f["section"])))]
    best = ev.best_items(sections, wanted, limit, bool(figures))(*sections, *figures)
    per = F.arrays_zip(F.array(*map(F.lit, wanted)).alias("dimension"), F.col("_best").alias("evidence"))
    out = papers.select(*keep, best.alias("_best")).select(*keep, F.explode(per).alias("_e")).select(*keep, "_e.dimension", "_e.evidence")
    return out.withColumn("evidence", F.transform("evidence", _trimmed)) if trim else out


def signal_groups_of(text: Column, signals: dict[str, list[str]]) -> Column:
    """Names of the signal groups that a sentence without negation mentions."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+|\n", -1)
    plain = F.filter(parts, lambda s: ~s.rlike(rv.NEGATION))

    def groups(ss: Column) -> Column:
        def mentions(ks: list[str]) -> Column:
            return F.exists(ss, lambda s: contains_any(s, ks))

        hits = [F.when(mentions(ks), F.lit(n)) for n, ks in signals.items()]
        return F.filter(F.array(*hits), lambda x: x.isNotNull())

    return let(plain, groups)


def signal_groups(docs: DataFrame, signals: dict[str, list[str]] | None = None, text: str = "text") -> DataFrame:
    return docs.withColumn("groups", signal_groups_of(F.col(text), signals or rv.REPRO_SIGNALS))


# ---- verdicts --------------------------------------------------------------------------------------------


def local_verdict(dimension: Column, evidence: Column, extra: Column) -> Column:
    """Verdict by counted keywords; novelty also reads the abstract and introduction."""
    texts = F.struct(F.lower(F.array_join(evidence, " ")).alias("joined"), F.lower(F.coalesce(extra, F.lit(""))).alias("extra"))
    none = F.lit(rv.NOT_ENOUGH)
    return F.when(F.size(evidence) == 0, none).otherwise(
        let(texts, lambda t: _verdict_rules(dimension, t["joined"], F.concat(t["joined"], F.lit(" "), t["extra"])))
    )


def _verdict_rules(dimension: Column, joined: Column, scan: Column) -> Column:
    v = rv.VERDICTS
    none = F.lit(rv.NOT_ENOUGH)
    strong = (count_contained(joined, rv.STRENGTH_WORDS) >= 2) | joined.rlike(r"\d[\d.]*\s*(%|pp|point|score)")
    novelty = (
        F.when(contains_any(scan, rv.FOUNDATIONAL_WORDS), v["novelty"][0])
        .when(contains_any(scan, rv.EFFICIENCY_WORDS), v["novelty"][1])
        .when(contains_any(scan, rv.EXTENSION_WORDS) | contains_any(scan, rv.WEAK_NOVELTY_WORDS), v["novelty"][2])
        .otherwise(none)
    )
    by_dimension = {
        "strengths": F.when(strong, v["strengths"][1]).otherwise(v["strengths"][2]),
        "weaknesses": F.when(contains_any(joined, rv.WEAKNESS_WORDS), v["weaknesses"][1]).otherwise(none),
        "novelty": novelty,
        "threats_to_validity": F.when(contains_any(joined, rv.THREAT_WORDS), v["threats_to_validity"][1]).otherwise(none),
        "assumptions": F.lit(v["assumptions"][1]),
        "reproducibility": F.lit(v["reproducibility"][1]),
        "fairness_of_comparison": F.lit(v["fairness_of_comparison"][1]),
        "applicability": F.lit(v["applicability"][1]),
    }
    return F.coalesce(*[F.when(dimension == d, verdict) for d, verdict in by_dimension.items()], none)


def verdicts(evidence: DataFrame, extra: str | None = None) -> DataFrame:
    """Adds ``verdict`` to (paper_id, dimension, evidence)."""
    more = F.col(extra) if extra else F.lit("")
    return evidence.withColumn("verdict", local_verdict(F.col("dimension"), F.col("evidence"), more))


def normal_confidence(c: Column) -> Column:
    low = F.lower(squeeze(F.coalesce(c, F.lit(""))))
    return F.when(low == "high", "High").when(low == "medium", "Medium").otherwise("Low")


def capped_confidence(confidence: Column, evidence: Column) -> Column:
    """High needs three concrete items and no generic phrase, Medium two."""
    generic = contains_any(F.lower(squeeze(F.array_join(evidence, " "))), rv.GENERIC_PHRASES)
    return _capped(confidence, specific_count(evidence), generic)


def _capped(confidence: Column, n: Column, generic: Column) -> Column:
    c = normal_confidence(confidence)
    c = F.when((c == "High") & (generic | (n < 3)), "Medium").otherwise(c)
    return F.when((c == "Medium") & (n < 2), "Low").otherwise(c)


def cap_confidence(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("confidence", capped_confidence(F.col("confidence"), F.col("evidence")))


def _label(dimension: Column) -> Column:
    return F.lower(F.coalesce(*[F.when(dimension == d, F.lit(n)) for d, n in rv.DIMENSIONS.items()], dimension))


def _missing(dimension: Column) -> Column:
    return F.concat(F.lit("Insufficient explicit evidence in the paper text to assess "), _label(dimension), F.lit(" confidently."))


def _grounded(evidence: Column) -> Column:
    return F.concat(
        F.lit("The judgement is grounded in explicit evidence from the extracted paper text, including "),
        F.array_join(F.slice(evidence, 1, 2), "; "), F.lit("."),
    )


def paper_profiles(papers: DataFrame) -> DataFrame:
    """(paper_id, dimension, verdict, rationale, evidence, confidence): eight rows per paper, without a shuffle.

    papers: paper_id and section columns.
    """
    extra = F.concat_ws(" ", F.col("abstract"), F.col("introduction"))
    out = select_evidence(papers.withColumn("_x", extra))
    more = F.when(F.col("dimension") == "novelty", squeeze(F.col("_x"))).otherwise("")
    out = out.withColumn("verdict", local_verdict(F.col("dimension"), F.col("evidence"), more))
    empty = F.col("verdict") == rv.NOT_ENOUGH
    return out.select(
        "paper_id", "dimension", "verdict",
        F.when(empty, _missing(F.col("dimension"))).otherwise(_grounded(F.col("evidence"))).alias("rationale"),
        F.when(empty, _strings()).otherwise(F.col("evidence")).alias("evidence"),
        F.lit("Low").alias("confidence"),
    )


# ---- controlled vocabulary -----------------------------------------------------------------------------------


def _word_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]{3,})"), F.lit(1)))


def controlled_verdict(dimension: Column, text: Column) -> Column:
    """The verdict of the vocabulary that shares most words (two at least) with free text; an equal one at once."""
    raw = squeeze(F.coalesce(text, F.lit("")))

    def choose(words: Column, options: list[str]) -> Column:
        shared = [F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in _py_words(o)]))) for o in options]
        best = F.greatest(*shared)
        same = [F.when(F.lower(raw) == o.lower(), F.lit(o)) for o in [*options, rv.NOT_ENOUGH]]
        near = [F.when((best >= 2) & (s == best), F.lit(o)) for s, o in zip(shared, options)]
        return F.coalesce(*same, *near, F.lit(rv.NOT_ENOUGH))

    def all_dimensions(words: Column) -> Column:
        return F.coalesce(
            *[F.when(dimension == d, choose(words, o)) for d, o in rv.VERDICTS.items()], F.when(raw != "", raw), F.lit(rv.NOT_ENOUGH)
        )

    return let(_word_set(raw), all_dimensions)


def _py_words(text: str) -> list[str]:
    return sorted(set(re.findall(r"\w{3,}", text.lower())))


def enforce_vocab(texts: DataFrame, dimension: str = "dimension", text: str = "verdict") -> DataFrame:
    return texts.withColumn(text, controlled_verdict(F.col(dimension), F.col(text)))


FOUNDATIONAL_A, FOUNDATIONAL_B = rv.PAIRWISE["novelty"][:2]


def _outcomes(dimension: str) -> list[str]:
    """The vocabulary's entries for A ahead, B ahead, both alike and insufficient evidence."""
    entries = rv.PAIRWISE[dimension]
    return [entries[i] for i in (3, 4, 2, 5)] if dimension == "novelty" else entries


def controlled_judgement(dimension: Column, text: Column) -> Column:
    """A free comparison mapped to the vocabulary by its direction."""
    low = F.lower(squeeze(F.coalesce(text, F.lit(""))))
    a = contains_any(low, rv.POSITIVE_A)
    b = contains_any(low, rv.POSITIVE_B)
    out = []
    for d, options in rv.PAIRWISE.items():
        ahead_a, ahead_b, alike, unclear = _outcomes(d)
        # The first vocabulary entry in favour of B mentions "Paper B appears" in novelty.
        favour_b = FOUNDATIONAL_A if d == "novelty" else ahead_b
        pick = F.coalesce(*[F.when(low == o.lower(), F.lit(o)) for o in options])
        rule = (
            F.when(a & ~b & F.lit(d != "novelty"), ahead_a)
            .when(b & ~a, favour_b)
            .when(contains_any(low, rv.INSUFFICIENT_WORDS), unclear)
            .when(contains_any(low, rv.ALIKE_WORDS), alike)
            .otherwise(unclear)
        )
        out.append(F.when(dimension == d, F.coalesce(pick, rule)))
    return F.coalesce(*out)


# ---- comparison -------------------------------------------------------------------------------------------------


def _strength() -> Column:
    """Concrete items, confidence and a bonus for a real verdict."""
    conf = normal_confidence(F.col("confidence"))
    return (
        specific_count(F.col("evidence"))
        + F.when(conf == "High", 3).when(conf == "Medium", 2).otherwise(1)
        + F.when(F.col("verdict") == rv.NOT_ENOUGH, 0).otherwise(2)
    )


def _typed() -> Column:
    """Whether the whole assessment names a type of novelty other than foundational."""
    text = F.lower(squeeze(F.concat_ws(" ", "verdict", "rationale", F.array_join("evidence", " "))))
    return F.when(F.col("dimension") == "novelty", contains_any(text, [w for ws in rv.NOVELTY_TYPE_WORDS.values() for w in ws]))


def _novelty_kind(side: str) -> tuple[Column, Column, Column]:
    """(foundational, extending) by verdict, and whether the whole assessment names a type other than foundational."""
    verdict = F.col(f"{side}.verdict")
    extending = contains_any(verdict, ["Efficiency innovation", "Incremental extension", "Practical", "Mixed novelty"])
    return verdict.contains("Foundational contribution"), extending, F.col(f"{side}.typed")


def _judgement() -> Column:
    """Rules over the two profile rows ``a`` and ``b`` and their strengths ``sa`` and ``sb``.

    Weaknesses, assumptions and threats are never ranked. Two papers of low confidence: a verdict against none wins, a lead of
    three counts for paper A only, which is the side the pair names first.
    """
    none_a, none_b = F.col("a.verdict") == rv.NOT_ENOUGH, F.col("b.verdict") == rv.NOT_ENOUGH
    both = ~none_a & ~none_b
    gap = F.col("sa") - F.col("sb")
    close = both & ((F.col("a.verdict") == F.col("b.verdict")) | (F.abs(gap) <= 1))
    sure_a, sure_b = normal_confidence(F.col("a.confidence")) != "Low", normal_confidence(F.col("b.confidence")) != "Low"
    found_a, ext_a, typed_a = _novelty_kind("a")
    found_b, ext_b, typed_b = _novelty_kind("b")
    per_dimension = []
    for d in rv.PAIRWISE:
        ahead_a, ahead_b, alike, unclear = _outcomes(d)
        if d == "novelty":
            rule = (
                F.when(none_a & none_b, unclear)
                .when(none_a, F.when(found_b, FOUNDATIONAL_B).otherwise(ahead_b))
                .when(none_b, F.when(found_a, FOUNDATIONAL_A).otherwise(ahead_a))
                .when(found_a & (ext_b | typed_b), FOUNDATIONAL_A)
                .when(found_b & (ext_a | typed_a), FOUNDATIONAL_B)
                .when(ext_a & ext_b, alike)
                .otherwise(unclear)
            )
        elif d in ("weaknesses", "assumptions", "threats_to_validity"):
            rule = F.lit(unclear)
        else:
            doubtful = (
                F.when(~none_a & none_b, ahead_a)
                .when(none_a & ~none_b, ahead_b)
                .when(both & (gap >= 3), ahead_a)
                .when(close, alike)
                .otherwise(unclear)
            )
            rule = (
                F.when(both & (F.abs(gap) >= 2) & F.lit(d == "strengths"), F.when(gap > 0, ahead_a).otherwise(ahead_b))
                .when(~sure_a & ~sure_b, doubtful)
                .when((gap >= 2) & sure_a, ahead_a)
                .when((-gap >= 2) & sure_b, ahead_b)
                .when(close, alike)
                .when((gap > 0) & (both | sure_a), ahead_a)
                .when((gap < 0) & (both | sure_b), ahead_b)
                .otherwise(unclear)
            )
        per_dimension.append(F.when(F.col("dimension") == d, rule))
    return F.coalesce(*per_dimension)


def _paired(pairs: DataFrame, profiles: DataFrame, items: int | None = None) -> DataFrame:
    """pairs (pair_id, paper_a, paper_b) with both profile rows per dimension, ``a`` and ``b``, and their strengths ``sa`` and ``sb``.

    What the rules need of a profile is worked out once, not for each pair, and written once, as both sides read it; of its evidence
    the first ``items`` go along, or all.
    """
    row = F.struct("verdict", first_of(F.col("evidence"), items).alias("evidence"), "confidence", _strength().alias("s"), _typed().alias("typed"))
    profiles = cut_lineage(profiles.select("paper_id", "dimension", row.alias("p")))
    a = profiles.select(F.col("paper_id").alias("paper_a"), "dimension", F.col("p").alias("a"))
    b = profiles.select(F.col("paper_id").alias("paper_b"), "dimension", F.col("p").alias("b"))
    both = pairs.join(a, "paper_a").join(b, ["paper_b", "dimension"])
    return both.withColumn("sa", F.col("a.s")).withColumn("sb", F.col("b.s"))


def _both_evidence() -> Column:
    tag = lambda side, name: F.transform(F.slice(F.col(f"{side}.evidence"), 1, 2), lambda e: F.concat(F.lit(f"{name}: "), e))
    return F.concat(tag("a", "Paper A"), tag("b", "Paper B"))


def _reason() -> Column:
    part = lambda side, name: F.concat(F.lit(f"{name}: '"), F.col(f"{side}.verdict"), F.lit("' (confidence: "), F.col(f"{side}.confidence"), F.lit(")."))
    return F.concat_ws(" ", part("a", "Paper A"), part("b", "Paper B"))


def compare_profiles(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(pair_id, dimension, verdict_a, verdict_b, judgement, rationale, evidence): two joins on (paper, dimension)."""
    both = _paired(pairs, profiles, 2)
    return both.select(
        "pair_id", "dimension", F.col("a.verdict").alias("verdict_a"), F.col("b.verdict").alias("verdict_b"),
        _judgement().alias("judgement"), _reason().alias("rationale"), clean_evidence(_both_evidence(), 6).alias("evidence"),
    )


# ---- consistency ----------------------------------------------------------------------------------------------------


def uncontradicted(evidence: Column) -> Column:
    """Drop "not evaluated" items about something that another item reports a number for."""
    low = lambda e: F.lower(e)
    tokens = word_array(rv.DATASET_TOKENS)
    measured = F.filter(evidence, lambda e: low(e).rlike(rv.METRIC_VALUE) | (contains_any(low(e), rv.DATASET_TOKENS) & e.rlike(r"\d")))

    def keep(ms: Column) -> Column:
        def contradicted(e: Column) -> Column:
            same = F.exists(tokens, lambda t: F.contains(low(e), t) & F.exists(ms, lambda m: F.contains(low(m), t)))
            task = F.contains(low(e), F.lit("text classification")) & F.exists(ms, lambda m: contains_any(low(m), rv.TEXT_DATASETS))
            return contains_any(low(e), rv.NOT_EVALUATED) & (same | task)

        return F.filter(evidence, lambda e: ~contradicted(e))

    return let(measured, keep)


def consistent_evidence(evidence: DataFrame) -> DataFrame:
    return evidence.withColumn("evidence", uncontradicted(F.col("evidence")))


def incomplete_papers(profiles: DataFrame) -> DataFrame:
    """(paper_id, missing): papers without a row for every dimension."""
    have = profiles.groupBy("paper_id").agg(F.collect_set("dimension").alias("have"))
    missing = F.array_except(F.array(*map(F.lit, rv.DIMENSIONS)), F.col("have"))
    return have.select("paper_id", missing.alias("missing")).where(F.size("missing") > 0)


def _scan_marks(papers: DataFrame) -> DataFrame:
    """(paper_id, dimension, _head, _tail, _found): what a dimension's guard finds in the part of a paper that it reads; texts stay in their row."""
    texts = {n: F.when(F.col(n) != "Not found", F.col(n)) for n in ("title", "authors", *rv.PAPER_SECTIONS) if n in papers.columns}
    if "key_figures" in papers.columns:
        texts["key_figures"] = F.array_join(F.transform("key_figures", lambda f: F.concat_ws(" ", f["label"], f["value"], f["context"], f["section"])), " ")
    found = ev.marks(list(texts))(*texts.values())
    rows = papers.select("paper_id", found.alias("_m")).select("paper_id", F.explode("_m").alias("_m"))
    return rows.select("paper_id", "_m.dimension", F.col("_m.head").alias("_head"), F.col("_m.tail").alias("_tail"), F.col("_m.found").alias("_found_in"))


def _novelty_verdict(found: Callable[[str], Column], said: Column) -> tuple[Column, Column]:
    """(verdict, foundational) by the words ``found`` in assessment and paper; ``said``: the written verdict in lower case."""
    typed = found("typed") & ~found("extending")
    foundational = found("strong") & (typed | said.contains("foundational"))
    kinds = {n: found(n) for n in rv.NOVELTY_TYPE_WORDS}
    paradigm, efficient, incremental, practical, both = rv.VERDICTS["novelty"]
    verdict = (
        F.when(foundational & kinds["efficiency"], both)
        .when(foundational, paradigm)
        .when(kinds["efficiency"], efficient)
        .when(kinds["practical"], practical)
        .when(kinds["extension"], incremental)
        .otherwise(rv.NOT_ENOUGH)
    )
    return verdict, foundational


def _reproducibility_rationale(groups: Column, evidence: Column) -> Column:
    absent = F.array_except(F.array(*map(F.lit, rv.REPRO_SIGNALS)), groups)
    part = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(title), F.array_join(F.array_sort(c), ", "), F.lit(".")))
    released = F.exists(evidence, lambda e: contains_any(F.lower(e), rv.RELEASE_WORDS) & ~contains_any(F.lower(e), rv.RELEASE_NEGATIVES))
    return F.concat_ws(" ", part("Reproducibility signals present: ", groups), part("Missing signals: ", absent), F.when(~released, rv.NO_RELEASE))


def normalize_assessments(assessments: DataFrame, extracted: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """Model-written assessments (paper_id, dimension, verdict, rationale, evidence, confidence) made consistent.

    Extracted evidence of the same paper and dimension is merged in, items off the dimension and contradicted ones go,
    verdicts come from the vocabulary, confidence is capped, and rows without evidence say so. Each dimension has a guard
    that reads the assessment and, with ``papers`` (paper_id and sections), the paper: novelty is classified anew,
    reproducibility and fairness need their signals, deployment words make an unclear applicability a constrained one,
    and weaknesses, threats and assumptions need words for them.
    """
    found = extracted.select("paper_id", "dimension", F.col("evidence").alias("_found"))
    rows = assessments.where(F.col("dimension").isin(list(rv.DIMENSIONS))).join(found, ["paper_id", "dimension"], "left")
    if papers is not None:
        rows = rows.join(_scan_marks(papers), ["paper_id", "dimension"], "left")
    else:
        rows = rows.withColumns({"_head": F.lit(""), "_tail": F.lit(""), "_found_in": _strings()})
    d = F.col("dimension")
    rows = rows.withColumn("_v", controlled_verdict(d, F.col("verdict")))
    merged = F.concat(F.coalesce("evidence", _strings()), F.coalesce("_found", _strings()))
    rows = rows.withColumn("_e", ev.on_dimension(d, F.col("_v"), merged, 6)).drop("evidence", "_found")
    rows = rows.withColumn("_s", ev.settled(d, F.concat_ws(" ", "verdict", "rationale"), F.col("_e")))
    rows = rows.select("paper_id", "dimension", "verdict", "rationale", "confidence", "_head", "_tail", "_found_in", "_v", *[f"_s.{c}" for c in ("e", "n", "text", "empty", "items", "n_items", "generic")])
    scan = F.concat_ws(" ", "_tail", F.array_join("e", " "))
    groups = F.when(d == "reproducibility", signal_groups_of(scan, rv.REPRO_SIGNALS)).when(
        d == "fairness_of_comparison", signal_groups_of(scan, rv.FAIRNESS_SIGNALS)
    )
    rows = rows.withColumns({"_g": F.array_union(F.coalesce("_found_in", _strings()), F.coalesce(groups, _strings())), "_near": F.lower(F.concat_ws(" ", "text", "_head"))})

    def named(words: list[str], name: str) -> Column:
        """Whether one of the words is in the assessment, in the paper or where they meet."""
        return contains_any(F.col("_near"), words) | F.coalesce(F.array_contains("_found_in", name), F.lit(False))

    e, n, g, v = F.col("e"), F.col("n"), F.col("_g"), F.col("_v")
    has = lambda name: F.array_contains(g, name)
    said = F.lower(squeeze(F.coalesce("verdict", F.lit(""))))
    written = F.coalesce("rationale", F.lit(""))
    vague = (written == "") | contains_any(F.lower(squeeze(written)), rv.GENERIC_PHRASES)
    own = F.when(vague, _grounded(e)).otherwise(written)

    novelty, foundational = _novelty_verdict(lambda name: named(ev.SOURCE_FLAGS[name], name), said)
    assertive = contains_any(F.lower(squeeze(written)), rv.ASSERTIVE_PHRASES)

    enough = has("hyperparameters") & has("data") & (has("setup") | has("protocol"))
    strong = enough & (F.size(g) >= 4)
    release = has("release") & ~F.exists(e, lambda x: x.rlike(rv.RELEASE_NEGATION))
    reasonable, partial = rv.VERDICTS["reproducibility"][:2]
    because = _reproducibility_rationale(g, e)
    because = F.when(~enough, F.concat_ws(" ", because, F.lit(rv.CORE_MISSING))).when(strong & release, because).otherwise(
        F.concat_ws(" ", because, F.lit(rv.RELEASE_INCOMPLETE))
    )

    fair_enough = (has("baselines") & has("metrics")) | (contains_any(said, rv.FAIR_VERDICT_WORDS) & (n >= 2))
    fair, partly_fair = rv.VERDICTS["fairness_of_comparison"][:2]
    fair_because = F.when(has("controls"), _grounded(e)).otherwise(F.concat_ws(" ", _grounded(e), F.lit(rv.CONTROLS_UNCLEAR)))

    deploy = F.filter(word_array(rv.DEPLOY_SIGNALS), lambda w: F.contains(F.col("_near"), w) | F.array_contains(F.coalesce("_found_in", _strings()), w))
    constrained = (d == "applicability") & (F.size(deploy) >= 2) & v.isin(rv.NOT_ENOUGH, rv.VERDICTS["applicability"][2])
    deployed = F.concat(
        F.lit("The paper contains explicit deployment-relevant signals ("), F.array_join(F.slice(deploy, 1, 4), ", "),
        F.lit("), which allow an applicability assessment grounded in the extracted text."),
    )

    worded = named(rv.THREAT_TOKENS, "worded") | (~said.isin(rv.NOT_ENOUGH.lower(), "") & (n >= 1))
    refused = (
        F.col("empty")
        | ((d == "reproducibility") & ~enough & (F.size(g) == 0))
        | ((d == "fairness_of_comparison") & ~fair_enough)
        | (d.isin("weaknesses", "threats_to_validity") & ~worded)
        | ((d == "assumptions") & ~named(rv.ASSUMPTION_TOKENS, "worded"))
    )
    rows = rows.withColumns(
        {
            "_refused": refused,
            "_verdict": F.when(refused, rv.NOT_ENOUGH)
            .when(d == "novelty", novelty)
            .when(d == "reproducibility", F.when(strong & release, reasonable).otherwise(partial))
            .when(d == "fairness_of_comparison", F.when(has("controls"), fair).otherwise(partly_fair))
            .when(constrained, rv.VERDICTS["applicability"][1])
            .otherwise(v),
            "_why": F.when(d == "novelty", F.when(vague | assertive, rv.PLAIN_NOVELTY_RATIONALE).otherwise(written))
            .when(d == "reproducibility", because)
            .when(d == "fairness_of_comparison", fair_because)
            .when(constrained, deployed)
            .otherwise(own),
            "_sure": F.when(d == "novelty", F.when((n >= 3) & foundational, "High").otherwise("Medium"))
            .when(d == "reproducibility", F.when(~enough, "Low").when(release & strong, "High").otherwise("Medium"))
            .when(d == "fairness_of_comparison", F.when(has("controls") & (F.size(g) >= 4), "High").otherwise("Medium"))
            .when(constrained, F.when(n >= 2, "Medium").otherwise("Low"))
            .otherwise(F.col("confidence")),
            "_items": F.when(refused, _strings()).otherwise(F.col("items")),
        }
    )
    nee = F.col("_verdict") == rv.NOT_ENOUGH
    special = F.coalesce(*[F.when(d == k, F.lit(t)) for k, t in rv.MISSING_EVIDENCE.items()], _missing(d))
    rationale = F.when(F.col("_refused"), special).when(nee & F.col("_why").rlike(rv.ASSERTIVE_RATIONALE), rv.NEUTRAL_RATIONALE).otherwise(F.col("_why"))
    capped = F.when(F.col("_refused"), _capped(F.col("_sure"), F.lit(0), F.lit(False))).otherwise(_capped(F.col("_sure"), F.col("n_items"), F.col("generic")))
    # the rationales of fairness and reproducibility name what is absent by rule
    doubtful = ~nee & F.col("_why").rlike(rv.ABSENCE_RATIONALE) & (capped == "High") & (d != "fairness_of_comparison")
    return rows.select(
        "paper_id", "dimension", F.col("_verdict").alias("verdict"), rationale.alias("rationale"),
        F.when(nee, F.filter("_items", lambda x: ~x.rlike(rv.POSITIVE_METRIC))).otherwise(F.col("_items")).alias("evidence"),
        F.when(nee | doubtful, "Low").otherwise(capped).alias("confidence"),
    )


def normalize_pairwise(raw: DataFrame, pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Model-written comparison rows made consistent with the profiles; one row per pair and dimension.

    raw: pair_id, pos, dimension, judgement, rationale, evidence. The first row of a dimension counts; missing,
    generic or unfounded ones are replaced by the local comparison. Evidence: at most six items, of the first four
    written ones those that neither profile holds.
    """
    valid = raw.withColumn("dimension", F.lower(squeeze(F.col("dimension")))).where(F.col("dimension").isin(list(rv.DIMENSIONS)))
    first = first_rows(valid, ["pair_id", "dimension"], ["pos"]).select(
        "pair_id", "dimension", F.struct("judgement", "rationale", clean_evidence(F.col("evidence"), 4).alias("evidence"), F.slice("evidence", 1, 4).alias("raw")).alias("r")
    )
    rows = _paired(pairs, profiles).join(first, ["pair_id", "dimension"], "left").withColumn("local", _judgement())
    said = F.lower(squeeze(F.concat_ws(" ", "r.judgement", "r.rationale", F.array_join("r.evidence", " "))))
    vague = contains_any(said, rv.ASSERTIVE_PHRASES + rv.GENERIC_PHRASES) & (specific_count(F.col("r.evidence")) == 0)
    none = (F.col("a.verdict") == rv.NOT_ENOUGH) & (F.col("b.verdict") == rv.NOT_ENOUGH)
    use_local = F.col("r").isNull() | vague | said.contains(rv.PAIRWISE_FALLBACK.lower())
    enforced = controlled_judgement(F.col("dimension"), F.col("r.judgement"))
    found_a, _, _ = _novelty_kind("a")
    found_b, _, _ = _novelty_kind("b")
    plain = lambda side: contains_any(F.col(f"{side}.verdict"), ["Efficiency innovation", "Incremental extension", "Practical or engineering innovation"])
    novelty = F.col("dimension") == "novelty"
    alike = contains_any(enforced, ["Both", "comparable", "similar"])
    ahead = lambda i: F.coalesce(*[F.when(F.col("dimension") == d, F.lit(_outcomes(d)[i])) for d in rv.PAIRWISE])
    gap = F.col("sa") - F.col("sb")
    sure = lambda side: normal_confidence(F.col(f"{side}.confidence")) != "Low"
    judged = (
        F.when(novelty & found_a & plain("b"), FOUNDATIONAL_A)
        .when(novelty & found_b & plain("a"), FOUNDATIONAL_B)
        .when(novelty & found_a & found_b & (enforced == _outcomes("novelty")[2]), _outcomes("novelty")[3])
        .when(~novelty & alike & (gap >= 3) & sure("a"), ahead(0))
        .when(~novelty & alike & (-gap >= 3) & sure("b"), ahead(1))
        .otherwise(enforced)
    )
    # of the written evidence, what neither profile holds stands before the profiles' own
    plain_items = lambda c: F.transform(c, lambda e: F.lower(clean_bullet(e)))
    held = F.concat(plain_items(F.col("a.evidence")), plain_items(F.col("b.evidence")))
    fresh = F.filter(F.coalesce("r.raw", _strings()), lambda e: ~F.array_contains(held, F.lower(clean_bullet(e))))
    own = clean_evidence(F.concat(fresh, _both_evidence()), 6)
    evidence = F.when(use_local, own).otherwise(clean_evidence(F.concat(F.coalesce("r.evidence", _strings()), own), 6))
    return rows.select(
        "pair_id", "dimension", F.col("a.verdict").alias("verdict_a"), F.col("b.verdict").alias("verdict_b"),
        F.when(none, ahead(3)).when(use_local, F.col("local")).otherwise(judged).alias("judgement"),
        F.when(none | use_local | (F.coalesce("r.rationale", F.lit("")) == ""), _reason()).otherwise(F.col("r.rationale")).alias("rationale"),
        F.when(none, _strings()).otherwise(evidence).alias("evidence"),
        use_local.alias("is_local"),
    )


# ---- markdown -----------------------------------------------------------------------------------------------------------


def comparison_markdown(comparisons: DataFrame) -> DataFrame:
    """(pair_id, markdown): the eight comparison rows of a pair as a document, in dimension order."""
    order = F.coalesce(*[F.when(F.col("dimension") == d, F.lit(i)) for i, d in enumerate(rv.DIMENSIONS)])
    title = F.coalesce(*[F.when(F.col("dimension") == d, F.lit(n)) for d, n in rv.DIMENSIONS.items()])
    items = F.when(F.size("evidence") > 0, F.transform("evidence", lambda e: F.concat(F.lit("- "), e))).otherwise(
        F.array(F.lit("- No explicit evidence extracted."))
    )
    block = F.concat_ws(
        "\n", F.concat(F.lit("### "), title), F.concat(F.lit("**Paper A:** "), "verdict_a"), F.concat(F.lit("**Paper B:** "), "verdict_b"),
        F.concat(F.lit("**Comparative Judgement:** "), "judgement"), "rationale", F.lit("**Evidence:**"), F.array_join(items, "\n"), F.lit(""),
    )
    rows = comparisons.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), block.alias("b")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["b"]), "\n")
    return rows.select("pair_id", strip(F.concat(F.lit("# Critical Comparison\n\n## Direct Comparison\n\n"), body)).alias("markdown"))
