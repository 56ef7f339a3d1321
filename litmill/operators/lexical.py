"""Lexical retrieval: BM25 over stored postings (``postings``), boosts, keyword matching."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litmill.functions import fixed_values as fv
from litmill.functions.skew import top_k
from litmill.functions.text import contains_any, first_of, let, squeeze, tokens_of
from litmill.operators.lines import excerpt_of, requested_numbers
from litmill.operators.postings import PostingStore, impact
from litmill.session import cut_lineage, ensure_checkpoint_dir


def tokens(df: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    return df.withColumn(out, tokens_of(F.col(text)))


def counted(items: Column) -> Column:
    """array<struct<term, tf>> of one array, by sorting it: no shuffle."""

    def runs(s: Column) -> Column:
        none = F.array().cast("array<int>")
        starts = F.when(
            F.size(s) > 0,
            F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))),
        ).otherwise(none)
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda p, j: F.struct(
                    F.get(s, p).alias("term"), (F.coalesce(F.get(st, j + 1), F.size(s)) - p).alias("tf")
                ),
            ),
        )

    return let(F.array_sort(items), runs)


def counted_in_place(items: Column) -> Column:
    """array<struct<term, tf, at>> of one array without nulls: as ``counted``, with the place (from 1) where each term comes first.

    Places are sorted along with the items: looking each term up in the array would take terms times items.
    """

    def runs(s: Column) -> Column:
        new = lambda i: (i == 0) | (F.get(s, i)["term"] != F.get(s, i - 1)["term"])
        starts = F.when(F.size(s) > 0, F.filter(F.sequence(F.lit(0), F.size(s) - 1), new)).otherwise(F.array().cast("array<int>"))
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda p, j: F.struct(
                    F.get(s, p)["term"].alias("term"), (F.coalesce(F.get(st, j + 1), F.size(s)) - p).alias("tf"), F.get(s, p)["at"].alias("at")
                ),
            ),
        )

    return let(F.sort_array(F.transform(items, lambda t, i: F.struct(t.alias("term"), (i + 1).alias("at")))), runs)


def lexical_index(chunks: DataFrame, text: str = "text", key: str = "chunk_id") -> PostingStore:
    """An index of a chunk table in a folder of its own; ``PostingStore`` keeps one and appends to it."""
    spark = chunks.sparkSession
    return PostingStore(spark, f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}").append(chunks, text, key)


def query_terms(queries: DataFrame, text: str = "query", key: str = "query_id") -> DataFrame:
    """(key, term, qf): distinct tokens of a question with their counts."""
    return queries.select(key, F.explode(counted(tokens_of(F.col(text)))).alias("q")).select(
        key, F.col("q.term").alias("term"), F.col("q.tf").alias("qf")
    )


def bm25_scores(queries: DataFrame, index: PostingStore, key: str = "query_id", only: DataFrame | None = None) -> DataFrame:
    """(key, chunk_id, score) for every chunk, or every one of ``only`` (chunk_id), that shares a term with the question.

    Document frequencies are counted over the whole corpus but only for terms that are asked for.
    A frequent term makes a large join partition, which adaptive execution splits; scores are summed
    on the map side before they are shuffled by (key, chunk_id). ``bm25`` finds the best ones without scoring all.
    """
    asked = query_terms(queries, key=key)
    wanted = asked.select("term").distinct()
    hits = index.postings.join(wanted, "term", "left_semi")
    hits = hits if only is None else hits.join(only, "chunk_id", "left_semi")
    weights = asked.join(index.terms.join(wanted, "term", "left_semi"), "term").withColumn(
        "weight",
        F.log(1 + (index.stats.select("n_chunks").scalar() - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("qf"),
    )
    avg_len = index.stats.select(F.greatest(F.lit(1.0), F.col("avg_len"))).scalar()
    part = impact(F.col("tf"), F.greatest(F.col("dl"), F.lit(1)), avg_len)
    return (
        hits.withColumn("part", part)
        .join(weights.select(key, "term", "weight"), "term")
        .groupBy(key, "chunk_id")
        .agg(F.sum(F.col("weight") * F.col("part")).alias("score"))
    )


def ranked(scores: DataFrame, k: int, key: str = "query_id", chunk: str = "chunk_id") -> DataFrame:
    """Top k per question; scores equal to nine digits are ordered by chunk id."""
    return top_k(scores, [key], [F.round("score", 9).desc(), F.col(chunk)], k)


def bm25(queries: DataFrame, index: PostingStore, k: int = 5, chunks: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank). Where questions ``want`` a chunk type, the type restricts the
    chunks (chunk_id, chunk_type), not the statistics."""
    terms = query_terms(queries)
    if "want" not in queries.columns:
        return index.search(terms, k).results
    terms = terms.join(queries.select("query_id", "want"), "query_id")
    return index.search(terms, k, kinds=chunks.select("chunk_id", "chunk_type")).results


# ---- substring matches without scanning every pair ------------------------------------------------


def containing_terms(wanted: DataFrame, terms: DataFrame) -> DataFrame:
    """(needle, term): index terms that contain a wanted token.

    Equi join on the first three (or two) characters of the token against the distinct grams of each
    term, then a check; tokens and terms are distinct, so texts are never compared with each other.
    """

    def grams(c: Column, n: int) -> Column:
        return F.when(
            F.length(c) >= n,
            F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))),
        ).otherwise(F.array().cast("array<string>"))

    needles = wanted.select(
        F.col("term").alias("needle"),
        F.substring("term", 1, 3).alias("gram"),
    ).distinct()
    term = F.col("term")
    by_gram = terms.select("term", F.explode(F.concat(grams(term, 2), grams(term, 3))).alias("gram"))
    return needles.join(by_gram, "gram").where(F.contains("term", F.col("needle"))).select("needle", "term")


def _digit_parts(run: Column) -> Column:
    """All pieces of a digit run that a number of up to 19 digits can equal."""
    return F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.length(run)),
            lambda i: F.transform(
                F.sequence(F.lit(1), F.least(F.length(run) - i + 1, F.lit(19))), lambda n: F.substring(run, i, n)
            ),
        )
    )


def _boosted_pairs(queries: DataFrame, lead: DataFrame, inside: DataFrame, digits: DataFrame, allowed: DataFrame, extra: Column, index: PostingStore) -> DataFrame:
    """(query_id, chunk_id, score) of all pairs that match, the parts of rows with the same chunk id added up."""
    only = allowed.select("chunk_id").distinct()
    postings = index.postings.select("term", "chunk_id").join(only, "chunk_id", "left_semi")
    substring_hits = (
        lead.join(inside, "needle")
        .select("query_id", "term")
        .distinct()
        .join(postings, "term")
        .groupBy("query_id", "chunk_id")
        .agg(F.lit(fv.BOOST_SUBSTRING).alias("part"))
    )
    numbered = allowed.where("number is not null").select("chunk_id", F.col("number").cast("string").alias("digits"))
    number_hits = digits.join(numbered, "digits").select("query_id", "chunk_id", F.lit(fv.BOOST_NUMBER).alias("part"))
    matched = (
        bm25_scores(queries, index, only=only)
        .withColumnRenamed("score", "part")
        .unionByName(substring_hits)
        .unionByName(number_hits)
        .groupBy("query_id", "chunk_id")
        .agg(F.sum("part").alias("part"))
    )
    fixed = allowed.select("chunk_id", extra.alias("extra"))
    return matched.join(fixed, "chunk_id").select("query_id", "chunk_id", (F.col("part") + F.col("extra")).alias("score"))


def bm25_boosted(
    queries: DataFrame, chunks: DataFrame, index: PostingStore, k: int = 5, chunk_type: str | None = None
) -> DataFrame:
    """BM25 plus boosts: chunk type, a token of the question inside the text, the element number in the question,
    and the priority of elements. Chunks need chunk_type, number (nullable) and content_priority.

    Chunks are scored zone by zone (``PostingStore.boosted``), where the k best of a zone go on; ids that repeat, or are not stored, are
    scored as pairs of question and chunk. Chunks without any match keep a fixed score that no question changes.
    Everything before such a chunk in the list of fixed scores scores at least as much, so only the first k of that
    list can be among the best k of any question.
    """
    terms = query_terms(queries)
    lead = terms.select("query_id", F.col("term").alias("needle")).distinct()
    allowed = chunks if chunk_type is None else chunks.where(F.col("chunk_type") == chunk_type)
    inside = cut_lineage(containing_terms(lead.select(F.col("needle").alias("term")).distinct(), index.terms.select("term")))
    runs = F.array_distinct(F.regexp_extract_all("query", F.lit(r"(\d+)"), F.lit(1)))
    digits = queries.select("query_id", F.explode(runs).alias("run"))
    digits = digits.select("query_id", F.explode(_digit_parts(F.col("run"))).alias("digits")).distinct()
    element = F.col("chunk_type").isin(fv.ELEMENT_TYPES)
    extra = F.lit(fv.BOOST_TYPE if chunk_type is not None else 0.0) + F.when(
        element, F.coalesce("content_priority", F.lit(1.0)) * fv.BOOST_PRIORITY
    ).otherwise(0.0)
    rows = allowed.where("chunk_id is not null").select("chunk_id", extra.alias("extra"), F.col("number").cast("string").alias("digits"))
    rows = rows.unionByName(index.zones().select(F.explode("chunks").alias("chunk_id")).where("chunk_id is not null"), allowMissingColumns=True)
    found = F.col("extra").isNotNull()
    counts = rows.groupBy("chunk_id").agg(F.count_if(found).alias("n"), F.count_if(~found).alias("stored"), F.max("extra").alias("extra"), F.max("digits").alias("digits"))
    counts = cut_lineage(counts.where("n > 0"))
    twice = counts.where("n > 1 or stored <> 1").select("chunk_id")
    scored = index.boosted(terms, inside, digits, counts.where("n = 1 and stored = 1").select("chunk_id", "extra", "digits"), k)
    fixed = allowed.select("chunk_id", extra.alias("extra"))
    if not twice.isEmpty():
        scored = scored.unionByName(_boosted_pairs(queries, lead, inside, digits, allowed.join(twice, "chunk_id", "left_semi"), extra, index))

    spare = fixed.where("extra > 0").orderBy(F.round("extra", 9).desc(), "chunk_id").limit(k)
    spare_list = spare.agg(F.collect_list(F.struct("chunk_id", "extra")).alias("s")).select("s").scalar()
    asked = queries.where(F.size(tokens_of(F.col("query"))) > 0).select("query_id").distinct()
    unmatched = asked.select("query_id", F.explode(spare_list).alias("s")).select(
        "query_id", "s.chunk_id", F.col("s.extra").alias("score")
    )
    both = scored.unionByName(unmatched).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return ranked(both.where("score > 0"), k)


# ---- terms and focus of a question -------------------------------------------------------------


def key_terms_of(query: Column, limit: int | None = None) -> Column:
    """Distinct content words of a question in order."""
    found = F.regexp_extract_all(F.lower(query), F.lit(r"([a-z][a-z0-9\-]+)"), F.lit(1))
    return first_of(F.array_distinct(F.filter(found, lambda t: ~t.isin(fv.QUERY_STOP_WORDS))), limit)


def focus_term_of(query: Column) -> Column:
    """What a question is about: the rest after "what is" and the like, or the words after about / for / of."""
    q = F.rtrim(F.trim(query), F.lit("? "))
    out = None
    for prefix in fv.FOCUS_PREFIXES:
        rest = F.btrim(F.substring(q, F.lit(len(prefix) + 1), F.length(q)), F.lit(" ."))
        hit = F.lower(q).startswith(prefix)
        out = F.when(hit, rest) if out is None else out.when(hit, rest)
    return out.otherwise(F.trim(F.regexp_extract(q, r"(?:about|for|of)\s+([A-Za-z][A-Za-z0-9\- ]{2,})", 1)))


def is_summary(query: Column) -> Column:
    return contains_any(F.lower(query), fv.SUMMARY_WORDS)


def is_limitations(query: Column) -> Column:
    return contains_any(F.lower(query), fv.LIMITATION_WORDS)


def is_definition(query: Column) -> Column:
    low = F.lower(query)
    starts = low.startswith(fv.DEFINITION_STARTS[0]) | low.startswith(fv.DEFINITION_STARTS[1])
    return starts | contains_any(low, fv.DEFINITION_WORDS)


def is_explanation(query: Column) -> Column:
    return contains_any(F.lower(query), fv.EXPLANATION_WORDS)


def _term_hits(text: Column, terms: Column) -> Column:
    return F.size(F.filter(terms, lambda t: F.contains(text, t)))


# ---- search inside the document a question is about ---------------------------------------------------


def keyword_search(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, chunk_id, score, rank): one point per term of the question in a chunk of its document,
    1.5 more when two neighbouring terms stand together.

    queries: query_id, doc_id, query. chunks: chunk_id, doc_id, text.
    """
    asked = queries.select("query_id", "doc_id", key_terms_of(F.col("query")).alias("terms")).where(F.size("terms") > 0)
    low = chunks.select("doc_id", "chunk_id", F.lower("text").alias("low"))
    pairs = F.when(
        F.size("terms") > 1,
        F.transform(
            F.sequence(F.lit(1), F.size("terms") - 1),
            lambda i: F.concat(F.element_at("terms", i), F.lit(" "), F.element_at("terms", i + 1)),
        ),
    ).otherwise(F.array().cast("array<string>"))
    asked = asked.withColumn("pairs", pairs)
    score = _term_hits(F.col("low"), F.col("terms")) + F.when(
        F.exists("pairs", lambda p: F.contains(F.col("low"), p)), 1.5
    ).otherwise(0.0)
    scored = asked.join(low, "doc_id").select("query_id", "chunk_id", score.alias("score")).where("score > 0")
    return ranked(scored, k)


def best_snippets(queries: DataFrame, pages: DataFrame, k: int = 2) -> DataFrame:
    """(query_id, rank, page_num, score, snippet): the pages of its document that answer a question best.

    pages: doc_id, page_num (first page is 1), text. The focus term counts four points.
    """
    q = F.col("query")
    asked = queries.select(
        "query_id", "doc_id", key_terms_of(q).alias("terms"), focus_term_of(q).alias("focus"), is_summary(q).alias("summary")
    )
    flat = pages.select("doc_id", "page_num", squeeze(F.col("text")).alias("flat"))
    flat = flat.where("flat != ''").withColumn("low", F.lower("flat"))
    score = (
        _term_hits(F.col("low"), F.col("terms")).cast("double")
        + F.when((F.col("focus") != "") & F.contains("low", F.lower("focus")), 4.0).otherwise(0.0)
        + F.when(F.col("summary") & (F.col("page_num") == 1), 1.5).otherwise(0.0)
    )
    scored = asked.join(flat, "doc_id").withColumn("score", score).where("score > 0")
    best = top_k(scored, ["query_id"], [F.col("score").desc(), F.col("page_num")], k)
    term = F.when(F.col("focus") != "", F.col("focus")).otherwise(F.coalesce(F.get("terms", F.lit(0)), F.lit("")))
    return best.select("query_id", "rank", "page_num", "score", excerpt_of(F.col("flat"), term).alias("snippet"))


def _field_score(text: Column, q: Column) -> Column:
    """2 when the whole question occurs, else the share of its words that do."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.split(q, r"\s+"), lambda w: w != "")
    share = _term_hits(low, words) / F.greatest(F.size(words), F.lit(1))
    return F.when(low == "", 0.0).when(F.contains(low, q), 2.0).otherwise(share)


def search_elements(
    queries: DataFrame, elements: DataFrame, chunks: DataFrame, element_type: str | None = None, k: int = 20
) -> DataFrame:
    """(query_id, rank, kind, label, page_num, score, item): tables, equations, figures and text of the
    document of each question.

    elements: doc_id, chunk_id, element_type, number, page_num, caption, text, section.
    chunks: doc_id, chunk_id, page_num, section, text.
    "table 3" scores 10 for that table; other elements need more than 0.3, text more than 0.5.
    """
    asked = queries.select("query_id", "doc_id", F.lower(F.trim("query")).alias("q"))
    q, number = F.col("q"), F.col("number").cast("string")
    names = {"table": ["table "], "equation": ["equation ", "eq "], "figure": ["figure ", "fig "]}
    exact = F.lit(False)
    for kind, starts in names.items():
        for start in [*starts, kind]:
            exact = exact | ((F.col("element_type") == kind) & (q == F.concat(F.lit(start), number)))
    fields = ["caption", "text", "section"]
    wanted = elements if element_type is None else elements.where(F.col("element_type") == element_type)
    found = asked.join(wanted, "doc_id").select(
        "query_id",
        F.col("element_type").alias("kind"),
        F.concat(F.initcap("element_type"), F.lit(" "), number).alias("label"),
        "page_num",
        F.when(exact, 10.0).otherwise(F.greatest(*[_field_score(F.col(f), q) for f in fields])).alias("score"),
        F.col("chunk_id").alias("item"),
    ).where("score > 0.3")
    if element_type in (None, "section", "keyword"):
        kind = "section" if element_type == "section" else "keyword"
        text_hits = asked.join(chunks, "doc_id").select(
            "query_id",
            F.lit(kind).alias("kind"),
            F.when(F.coalesce("section", F.lit("")) != "", F.col("section"))
            .otherwise(F.concat(F.lit("Page "), F.col("page_num").cast("string")))
            .alias("label"),
            "page_num",
            _field_score(F.col("text"), q).alias("score"),
            F.col("chunk_id").alias("item"),
        ).where("score > 0.5")
        found = text_hits if element_type else found.unionByName(text_hits)
    order = [F.round("score", 9).desc(), F.col("kind"), F.col("item")]
    return top_k(found, ["query_id"], order, k).select("query_id", "rank", "kind", "label", "page_num", "score", "item")


def keyword_boost(results: DataFrame, terms: list[str], strong: list[str] | None = None, text: str = "text") -> DataFrame:
    """Scores raised by 0.1 per domain term in the text (0.5 more for a strong one), capped at 1, ranked again."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))).cast("double")
    if strong:
        hits = hits + F.when(contains_any(low, strong), 5.0).otherwise(0.0)
    boosted = results.withColumn("score", F.least(F.lit(1.0), F.col("score") + hits * 0.1))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return boosted.withColumn("rank", F.row_number().over(w))


# ---- choosing elements --------------------------------------------------------------------------------


def element_score(query: Column) -> Column:
    """How well an element (element_type, number, caption, text) fits a lower-case question."""
    text = F.lower(F.concat_ws(" ", "caption", "text"))
    kind = F.col("element_type")

    def overlap(pattern: str) -> Column:
        terms = lambda c: F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
        return F.size(F.array_intersect(terms(query), terms(text)))

    def asked_number(pattern: str) -> Column:
        n = F.regexp_extract(query, pattern, 1)
        return F.when((n != "") & (n.cast("bigint") == F.col("number")), 100).otherwise(0)

    def shared(words: list[str], points: int) -> Column:
        total = F.lit(0)
        for w in words:
            total = total + F.when(query.contains(w) & text.contains(w), points).otherwise(0)
        return total

    def architecture() -> Column:
        points = F.lit(0)
        for w in fv.ARCHITECTURE_TEXT_WORDS:
            points = points + F.when(text.contains(w), 15).otherwise(0)
        return F.when(contains_any(query, fv.ARCHITECTURE_QUERY_WORDS), points).otherwise(0)

    return (
        F.when(kind == "equation", asked_number(r"\b(?:equation|eq\.?)\s*[(\[]?\s*(\d+)\s*[)\]]?") + overlap(r"([a-zA-Z0-9_\-()]+)"))
        .when(kind == "table", shared(fv.METRIC_WORDS, 30) + asked_number(r"\btable\s+(\d+)\b") + overlap(r"([a-zA-Z0-9\-]+)"))
        .otherwise(architecture() + overlap(r"([a-zA-Z0-9\-]+)"))
    )


def best_element(queries: DataFrame, elements: DataFrame) -> DataFrame:
    """(query_id, element_type, number, chunk_id, score): the best element of each type in the question's document.

    An aggregate, so the elements of a large document are reduced where they are read.
    """
    asked = queries.select("query_id", "doc_id", F.lower("query").alias("q"))
    pairs = asked.join(elements, "doc_id").withColumn("score", element_score(F.col("q")))
    order = F.struct(-F.col("score"), F.col("number"), F.col("page_num"), F.col("chunk_id"))
    best = pairs.groupBy("query_id", "element_type").agg(F.min_by(F.struct("number", "chunk_id", "score"), order).alias("b"))
    return best.select("query_id", "element_type", "b.number", "b.chunk_id", F.col("b.score").cast("bigint").alias("score"))


def asks_all(query: Column, kind: str) -> Column:
    low = F.lower(query)
    phrases = [f"show all {kind}", f"show me all {kind}", f"list all {kind}", f"list {kind}s", f"all {kind}", f"extract all {kind}s", f"show every {kind}"]
    return contains_any(low, phrases)


def select_elements(queries: DataFrame, elements: DataFrame) -> DataFrame:
    """(query_id, element_type, number, chunk_id, how): elements a question asks for.

    All of a type, those with the numbers named, or the best one when no number is found.
    """
    q = F.col("query")
    low = F.lower(q)
    topical = {
        "equation": contains_any(low, fv.EQUATION_WORDS) | is_explanation(q),
        "table": contains_any(low, fv.TABLE_WORDS),
        "figure": contains_any(low, fv.FIGURE_QUERY_WORDS),
    }
    rows = F.array(
        *[
            F.struct(
                F.lit(kind).alias("element_type"),
                asks_all(q, kind).alias("all"),
                about.alias("about"),
                requested_numbers(q, kind).alias("numbers"),
            )
            for kind, about in topical.items()
        ]
    )
    wants = queries.select("query_id", "doc_id", "query", F.explode(rows).alias("w")).select("query_id", "doc_id", "query", "w.*")
    wants = wants.where(F.col("all") | F.col("about"))
    e = elements.select("doc_id", "element_type", "number", "chunk_id")
    hits = wants.join(e, ["doc_id", "element_type"]).where(F.col("all") | F.array_contains("numbers", F.col("number")))
    direct = hits.select("query_id", "element_type", "number", "chunk_id", F.when(F.col("all"), "all").otherwise("number").alias("how"))
    left = wants.where(~F.col("all")).join(direct.select("query_id", "element_type").distinct(), ["query_id", "element_type"], "left_anti")
    best = best_element(left.select("query_id", "doc_id", "query").distinct(), elements).join(
        left.select("query_id", "element_type"), ["query_id", "element_type"], "left_semi"
    )
    return direct.unionByName(best.select("query_id", "element_type", "number", "chunk_id", F.lit("best").alias("how")))
