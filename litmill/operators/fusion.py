"""Fusing, expanding and reranking ranked results; context and citation text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litmill.functions import fixed_values as fv
from litmill.functions.skew import top_k
from litmill.functions.text import bigrams, count_contained, jaccard, squeeze, start_of, tokens_of, words
from litmill.operators import lexical
from litmill.operators.lexical import bm25, ranked
from litmill.operators.postings import PostingStore
from litmill.operators.vectors import knn
from litmill.session import cut_lineage


def rrf(results: list[DataFrame], k: int = 10, rrf_k: int = fv.RRF_K, key: str = "query_id") -> DataFrame:
    """(key, chunk_id, score, rank): sum of 1 / (rrf_k + rank) over result tables of (key, chunk_id, rank)."""
    both = reduce(DataFrame.unionByName, [r.select(key, "chunk_id", "rank") for r in results])
    fused = both.groupBy(key, "chunk_id").agg(F.sum(1.0 / (rrf_k + F.col("rank"))).alias("score"))
    return ranked(fused, k, key)


def best_rows(results: list[DataFrame], key: str = "query_id") -> DataFrame:
    """Per (key, chunk_id) the best score any of the tables gave."""
    both = reduce(DataFrame.unionByName, [r.select(key, "chunk_id", "score") for r in results])
    return both.groupBy(key, "chunk_id").agg(F.max("score").alias("best_score"))


def search_lists(rows: DataFrame, vectors: DataFrame, index: PostingStore, depth: int, chunks: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, rank, list): dense and lexical rankings of every question row, ``depth`` long.

    rows: query_id, query, embedding, optionally want. One pass over the vectors and one join with the
    postings serve all rows.
    """
    dense = knn(rows, vectors, depth).select("query_id", "chunk_id", "rank", F.lit("dense").alias("list"))
    lexical_ = bm25(rows, index, depth, chunks).select("query_id", "chunk_id", "rank", F.lit("lexical").alias("list"))
    return dense.unionByName(lexical_)


def fused(lists: DataFrame, k: int) -> DataFrame:
    """Both rankings cut at 3k and fused to the best k."""
    return rrf([lists.where(F.col("rank") <= 3 * k)], k)


def hybrid(queries: DataFrame, vectors: DataFrame, index: PostingStore, k: int = 5, chunks: DataFrame | None = None) -> DataFrame:
    """Dense and lexical top 3k, fused. queries: query_id, query, embedding, optionally want (a chunk type)."""
    return fused(search_lists(queries, vectors, index, 3 * k, chunks), k)


def _variant_rows(variants: DataFrame) -> DataFrame:
    """Distinct variants of a question, each with a row id of its own: question, query_id, query, embedding."""
    distinct = variants.where(F.trim("query") != "").groupBy("query_id", "query").agg(
        F.min("variant_no").alias("variant_no"), F.first("embedding").alias("embedding")
    )
    row = F.concat_ws("\u0001", F.col("query_id").cast("string"), F.col("variant_no").cast("string"))
    return distinct.select(F.col("query_id").alias("question"), row.alias("query_id"), "variant_no", "query", "embedding")


def _per_question(found: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    back = rows.select("query_id", "question")
    placed = found.join(back, "query_id").select(F.col("question").alias("query_id"), "chunk_id", "rank")
    return rrf([placed], k)


def multi_query_hybrid(variants: DataFrame, vectors: DataFrame, index: PostingStore, k: int = 5) -> DataFrame:
    """variants: query_id, variant_no, query, embedding. Each distinct variant brings its best 2k, fused per question."""
    rows = _variant_rows(variants)
    return _per_question(hybrid(rows, vectors, index, 2 * k), rows, k)


def parent_child(results: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, doc_id, page_num, chunk_id, score, rank): pages by the sum of their chunks' scores, with the best chunk."""
    placed = results.join(chunks.select("chunk_id", "doc_id", "page_num"), "chunk_id")
    best = F.min_by("chunk_id", F.struct(-F.round("score", 9), F.col("chunk_id")))
    pages = placed.groupBy("query_id", "doc_id", "page_num").agg(F.sum("score").alias("score"), best.alias("chunk_id"))
    return top_k(pages, ["query_id"], [F.round("score", 9).desc(), F.col("doc_id"), F.col("page_num")], k)


def _distinct_tokens(c: Column) -> Column:
    return F.array_distinct(tokens_of(c))


def rerank(queries: DataFrame, results: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """0.4 old score + 0.6 (token overlap + 0.3 x metadata tokens / question tokens), ranked again.

    queries: query_id, query; results: query_id, chunk_id, score; chunks: chunk_id, text and optionally
    caption, latex, description, section. Tokens are made only for chunks that were found.
    """
    found = chunks.join(results.select("chunk_id").distinct(), "chunk_id", "left_semi")
    extra = [F.col(c) for c in ("caption", "latex", "description", "section") if c in chunks.columns]
    toks = found.select(
        "chunk_id",
        _distinct_tokens(F.col("text")).alias("ct"),
        _distinct_tokens(F.concat_ws(" ", *extra) if extra else F.lit("")).alias("mt"),
    )
    asked = queries.select("query_id", _distinct_tokens(F.col("query")).alias("qt"))
    rows = results.select("query_id", "chunk_id", "score").join(asked, "query_id").join(toks, "chunk_id")
    meta = F.size(F.array_intersect("qt", "mt")) * fv.RERANK_META / F.greatest(F.size("qt"), F.lit(1))
    new = F.col("score") * fv.RERANK_BASE + (jaccard(F.col("qt"), F.col("ct")) + meta) * fv.RERANK_NEW
    score = F.when(F.size("qt") > 0, new).otherwise(F.col("score"))
    return ranked(rows.select("query_id", "chunk_id", score.alias("score")), k)


def ngram_score(query: Column, text: Column) -> Column:
    """0.6 x word overlap + 0.4 x word-pair overlap."""
    qw, cw = words(F.lower(query)), words(F.lower(text))
    uni = jaccard(F.array_distinct(qw), F.array_distinct(cw))
    return uni * fv.NGRAM_UNI + jaccard(bigrams(qw), bigrams(cw)) * fv.NGRAM_BI


def rerank_ngrams(queries: DataFrame, contexts: DataFrame, k: int = 6) -> DataFrame:
    """contexts: query_id, id, text, source_type, score. Graph facts get 0.05 more."""
    q = queries.select("query_id", words(F.lower("query")).alias("qw"))
    q = q.select("query_id", F.array_distinct("qw").alias("q1"), bigrams(F.col("qw")).alias("q2"))
    c = contexts.withColumn("_w", words(F.lower("text")))
    c = c.withColumn("_c1", F.array_distinct("_w")).withColumn("_c2", bigrams(F.col("_w"))).drop("_w")
    rows = q.join(c, "query_id")
    bi = F.when(F.size("q2") > 0, jaccard(F.col("q2"), F.col("_c2"))).otherwise(0.0)
    bonus = F.when(F.col("source_type") == fv.GRAPH_SOURCE, fv.GRAPH_BONUS).otherwise(0.0)
    score = F.col("score") + jaccard(F.col("q1"), F.col("_c1")) * fv.NGRAM_UNI + bi * fv.NGRAM_BI + bonus
    rows = rows.withColumn("score", score).drop("q1", "q2", "_c1", "_c2")
    return top_k(rows, ["query_id"], [F.round("score", 9).desc(), F.col("id")], k)


def rerank_with(queries: DataFrame, contexts: DataFrame, make_scorer: Callable[[], Callable[[list[str], list[str]], list[float]]], k: int = 6) -> DataFrame:
    """Rerank by a plugged-in scorer of (question, text) pairs; it is built once per task."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = make_scorer()
        for q, t in batches:
            yield pd.Series(scorer(q.tolist(), t.tolist()), dtype="float64")

    rows = contexts.join(queries.select("query_id", "query"), "query_id")
    rows = rows.withColumn("score", score("query", "text")).drop("query")
    return top_k(rows, ["query_id"], [F.round("score", 9).desc(), F.col("id")], k)


def all_contexts(vector_hits: DataFrame, graph_facts: DataFrame) -> DataFrame:
    """Text chunks and graph facts as one context table: query_id, id, text, source_type, score."""
    v = vector_hits.select(
        "query_id", F.concat(F.lit("Chunk "), F.col("chunk_id").cast("string")).alias("id"), "text",
        F.lit(fv.VECTOR_SOURCE).alias("source_type"), F.col("score").cast("double").alias("score"),
    )
    g = graph_facts.select(
        "query_id", F.concat(F.lit("KG Triplet "), F.col("fact_no").cast("string")).alias("id"), "text",
        F.lit(fv.GRAPH_SOURCE).alias("source_type"), F.lit(0.0).alias("score"),
    )
    return v.unionByName(g)


def build_context(contexts: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(query_id, context): numbered text blocks, then numbered facts. contexts carry the rank of a top-k table."""
    text = F.col("text")
    cut = F.rtrim(start_of(text, max_chars), F.lit(" \t\n\r\x0b\f"))
    if max_chars is not None:
        cut = F.concat(cut, F.when(F.length(text) > max_chars, "…").otherwise(""))
    item = F.struct("rank", F.when(F.col("source_type") == fv.VECTOR_SOURCE, cut).otherwise(text).alias("text"))
    per_source = lambda s: F.array_sort(F.collect_list(F.when(F.col("source_type") == s, item)))
    listed = contexts.groupBy("query_id").agg(per_source(fv.VECTOR_SOURCE).alias("v"), per_source(fv.GRAPH_SOURCE).alias("g"))

    def block(items: Column, header: str, letter: str) -> Column:
        numbered = F.transform(
            items, lambda x, i: F.concat(F.lit(f"**[{letter}"), (i + 1).cast("string"), F.lit("]** "), x["text"])
        )
        return F.when(F.size(items) > 0, F.concat(F.array(F.lit(header)), numbered)).otherwise(F.array().cast("array<string>"))

    parts = F.concat(block(F.col("v"), fv.VECTOR_HEADER, "V"), block(F.col("g"), fv.GRAPH_HEADER, "G"))
    return listed.select("query_id", F.btrim(F.array_join(parts, "\n\n"), F.lit(" \t\n\r\x0b\f")).alias("context"))


def collect_citations(sources: DataFrame, key: str = "answer_id") -> DataFrame:
    """(key, citations): labels of the sources of an answer, distinct, in order of first use.

    sources: key, pos, source_type, number, page_num. Repeated labels are reduced before the shuffle.
    """
    element = F.col("source_type").isin(fv.ELEMENT_TYPES)
    label = F.when(
        element, F.concat(F.lit("(Source: "), F.initcap("source_type"), F.lit(" "), F.coalesce(F.col("number").cast("string"), F.lit("?")), F.lit(")"))
    ).when(F.col("page_num").isNotNull(), F.concat(F.lit("(Source: Page "), F.col("page_num").cast("string"), F.lit(")")))
    firsts = sources.withColumn("label", label).where("label is not null").groupBy(key, "label").agg(F.min("pos").alias("pos"))
    listed = firsts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("l"))
    return listed.select(key, F.transform("l", lambda x: x["label"]).alias("citations"))


def rank_chunks(chunks: DataFrame, k: int | None = None) -> DataFrame:
    """Chunks of each document (the best ``k`` if given) by how many priority words they hold, one more for a heading mark; earlier first on a tie."""
    score = count_contained(F.lower("text"), fv.PRIORITY_KEYWORDS) + F.col("text").contains("##").cast("int")
    return top_k(chunks.withColumn("score", score), ["doc_id"], [F.col("score").desc(), F.col("chunk_no")], k)


# ---- the whole retrieval -----------------------------------------------------------------------------


def _direct_hits(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Named elements by number and whole lists of a type, from the document of the question."""
    c = chunks.select("chunk_id", F.col("doc_id").alias("c_doc"), "chunk_type", "number")
    same = (F.col("doc_id") == F.col("c_doc")) & (F.col("target_type") == F.col("chunk_type"))
    named = queries.where("query_type = 'specific_element' and target_number is not null")
    looked_up = named.join(c, same & (F.col("target_number") == F.col("number"))).groupBy("query_id").agg(F.min("chunk_id").alias("chunk_id"))
    looked_up = looked_up.select("query_id", "chunk_id", F.lit(1.0).alias("score"), F.lit(1).alias("rank"), F.lit("registry_lookup").alias("strategy"))
    lists = queries.where("query_type = 'list_all' and target_type is not null").join(c, same).select("query_id", "chunk_id")
    w = Window.partitionBy("query_id").orderBy("chunk_id")
    listed = lists.select("query_id", "chunk_id", F.lit(1.0).alias("score"), F.row_number().over(w).alias("rank"), F.lit("list_all").alias("strategy"))
    return looked_up.unionByName(listed)


def _wanted_type() -> Column:
    return F.when(F.col("query_type") != "general", F.col("target_type")).alias("want")


def route_retrieve(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, index: PostingStore, k: int = 5) -> DataFrame:
    """(query_id, chunk_id, score, rank, strategy): retrieval by intent.

    queries: query_id, doc_id, query, embedding and the intent columns query_type, target_type, target_number.
    A named element is looked up by number; "list all" returns every chunk of a type of its document;
    everything else, and what the lookups do not find, is a hybrid search within the type asked for.
    vectors: chunk_id, embedding, chunk_type. The classified questions are written once: every branch reads them.
    """
    queries = cut_lineage(queries)
    direct = _direct_hits(queries, chunks)
    rest = queries.join(direct.select("query_id").distinct(), "query_id", "left_anti")
    rows = rest.select("query_id", "query", "embedding", _wanted_type())
    searched = hybrid(rows, vectors, index, k, chunks).withColumn("strategy", F.lit("hybrid_rrf"))
    return direct.unionByName(searched)


def retrieve(queries: DataFrame, variants: DataFrame, chunks: DataFrame, vectors: DataFrame, index: PostingStore, k: int = 5) -> DataFrame:
    """(query_id, chunk_id, score, rank): the whole cascade for a batch of questions.

    Stages: all variants hybrid, best pages, intent route, and keywords for questions that found nothing.
    A chunk keeps the score of its first stage (routed chunks and keyword hits count 0.5); then everything
    is reranked by tokens. All stages share one search, written once as a table.
    """
    fetch = max(3 * k, 18)
    rows = cut_lineage(_variant_rows(variants))
    intents = cut_lineage(queries.drop("embedding"))
    direct = _direct_hits(intents, chunks)
    left = intents.join(direct.select("query_id").distinct(), "query_id", "left_anti")
    typed = (
        rows.join(left.select(F.col("query_id").alias("question"), _wanted_type()).where("want is not null"), "question")
        .withColumn("query_id", F.concat("query_id", F.lit("\u0001typed")))
    )
    every = rows.withColumn("want", F.lit(None).cast("string")).unionByName(typed)
    lists = cut_lineage(search_lists(every, vectors, index, 6 * fetch, chunks))

    def lists_of(part: DataFrame) -> DataFrame:
        return lists.join(part.select("query_id"), "query_id", "left_semi")

    wide = _per_question(fused(lists_of(rows), 2 * fetch), rows, fetch)
    first = rows.where("variant_no = 0")
    base = fused(lists_of(first), fetch).join(first.select("query_id", "question"), "query_id")
    base = base.select(F.col("question").alias("query_id"), "chunk_id", "score", "rank")
    pages = parent_child(base, chunks, k)
    routed = direct.select("query_id", "chunk_id", "rank").unionByName(
        _per_question(fused(lists_of(typed), 2 * fetch), typed, fetch).select("query_id", "chunk_id", "rank")
    ).withColumn("score", F.lit(0.5))
    staged = reduce(
        DataFrame.unionByName,
        [s.select("query_id", "chunk_id", "score", "rank", F.lit(i).alias("stage")) for i, s in enumerate([wide, pages, routed])],
    )
    firsts = staged.groupBy("query_id", "chunk_id").agg(F.min_by(F.struct("score", "stage", "rank"), F.struct("stage", "rank")).alias("s"))
    placed = top_k(firsts.select("query_id", "chunk_id", "s.*"), ["query_id", "stage"], [F.col("rank"), F.col("chunk_id")], fetch, "pos")
    kept = placed.join(_stage_room(placed, fetch), "query_id").where(F.col("pos") <= F.element_at("room", F.col("stage") + 1))
    empty_handed = intents.join(kept.select("query_id").distinct(), "query_id", "left_anti")
    fallback = lexical.keyword_search(empty_handed, chunks, k).select("query_id", "chunk_id", F.lit(0.5).alias("score"))
    return rerank(intents, kept.select("query_id", "chunk_id", "score").unionByName(fallback), chunks, k)


def _stage_room(placed: DataFrame, fetch: int) -> DataFrame:
    """How many chunks each stage may add: what is left of ``fetch``, at least one."""
    n = [F.count_if(F.col("stage") == i).cast("int") for i in range(2)]
    counts = placed.groupBy("query_id").agg(n[0].alias("n0"), n[1].alias("n1"))
    second = F.greatest(fetch - F.col("n0"), F.lit(1))
    third = F.greatest(fetch - F.col("n0") - F.least(F.col("n1"), second), F.lit(1))
    return counts.select("query_id", F.array(F.lit(fetch), second, third).alias("room"))


def extractive_answers(queries: DataFrame, pages: DataFrame, results: DataFrame, chunks: DataFrame, selected: DataFrame, abstracts: DataFrame) -> DataFrame:
    """(query_id, answer): text taken from the document of each question, or that it is not contained.

    Summary questions get the abstract and the best page; limitations, definitions and explanations the
    best pages; element questions name the element chosen for them; others the first retrieved chunk.
    """
    q = queries.select("query_id", "doc_id", F.col("query"), F.lower("query").alias("low"))
    source = lambda label, c: F.concat(F.lit(f" (Source: {label} "), c.cast("string"), F.lit(")"))
    snips = lexical.best_snippets(queries, pages, 2)
    snippet = F.concat(F.col("snippet"), source("Page", F.col("page_num")))
    pair = snips.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", snippet.alias("t")))).alias("s"))
    pair = pair.select("query_id", F.transform("s", lambda x: x["t"]).alias("snips"))
    best = selected.groupBy("query_id").pivot("element_type", list(fv.ELEMENT_TYPES)).agg(F.min("number"))
    top = results.where("rank = 1").join(chunks.select("chunk_id", "text", "page_num"), "chunk_id").select(
        "query_id", squeeze(F.col("text")).alias("first_text"), F.col("page_num").alias("first_page")
    )
    rows = (
        q.join(abstracts.select("doc_id", "abstract"), "doc_id", "left")
        .join(pair, "query_id", "left")
        .join(best, "query_id", "left")
        .join(top, "query_id", "left")
    )
    low = F.col("low")
    found = F.coalesce("snips", F.array().cast("array<string>"))
    summary = F.slice(
        F.concat(
            F.when(F.coalesce("abstract", F.lit("")) != "", F.array(F.col("abstract"))).otherwise(F.array().cast("array<string>")), found
        ), 1, 2,
    )
    missing = F.lit(fv.NOT_CONTAINED)
    has = lambda ws: lexical.contains_any(low, ws)

    def element(kind: str, sentence: str, end: str = "") -> Column:
        n = F.col(kind).cast("string")
        name = F.concat(F.lit(f"{kind.capitalize()} "), n)
        return F.when(F.col(kind).isNotNull(), F.concat(F.lit(sentence), name, F.lit(end), F.lit(" (Source: "), name, F.lit(")"))).otherwise(missing)

    equation = element("equation", "", fv.EQUATION_SENTENCE)
    direct = (lexical.is_limitations(low) | lexical.is_definition(low) | lexical.is_explanation(low))
    explained = F.when(lexical.is_explanation(low) & F.col("equation").isNotNull(), equation).when(F.size(found) > 0, F.array_join(found, "\n\n"))
    answer = F.coalesce(
        F.when(lexical.is_summary(low) & (F.size(summary) > 0), F.array_join(summary, "\n\n")),
        F.when(direct, explained),
        F.when(has(fv.EQUATION_WORDS), equation),
        F.when(has(fv.RESULT_WORDS), element("table", "The most relevant result is in ", ".")),
        F.when(has(fv.DIAGRAM_WORDS), element("figure", "The most relevant figure is ", ".")),
        F.when(F.coalesce("first_text", F.lit("")) != "", F.concat("first_text", F.lit("\n\n(Source: Page "), F.col("first_page").cast("string"), F.lit(")"))),
        missing,
    )
    return rows.select("query_id", answer.alias("answer"))
