"""Operators on lines, formulas, tables and excerpts of documents."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions import fixed_values as fv
from litmill.functions.text import WORD, contains_any, first_of, let, lines, squeeze, strip, strip_chars, word_count


def line_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no from 0, line) of every document."""
    return docs.select(key, F.posexplode(lines(F.coalesce(F.col(text), F.lit("")))).alias("line_no", "line"))


# ---- classification -------------------------------------------------------------------------


def content_type_of(c: Column) -> Column:
    low = F.lower(c)
    out = None
    for label, needles in fv.CONTENT_TYPES.items():
        hit = contains_any(low, needles)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("general")


def content_type(chunks: DataFrame, text: str = "text") -> DataFrame:
    return chunks.withColumn("content_type", content_type_of(F.col(text)))


def is_heading(line: Column) -> Column:
    t = strip(line)
    hit = F.lit(False)
    for p in fv.LINE_HEADING_PATTERNS:
        hit = hit | t.rlike(f"(?i){p}")
    return hit & (F.length(t) <= 100)


def detect_headings(line_rows: DataFrame) -> DataFrame:
    """Lines that look like section headings."""
    return line_rows.where(is_heading(F.col("line"))).withColumn("heading", strip(F.col("line")))


def looks_like_math(c: Column) -> Column:
    """Formula-like text: a math signal and structure, little prose, no caption, not long."""
    t = strip(F.coalesce(c, F.lit("")))

    def test(t: Column) -> Column:
        words = F.regexp_extract_all(t, F.lit(rf"([{WORD}]+)"), F.lit(1))
        prose = F.size(F.filter(words, lambda w: F.lower(w).isin(fv.PROSE_WORDS)))
        signal = F.lit(False)
        for p in fv.MATH_SIGNALS:
            signal = signal | t.rlike(p)
        structure = (
            contains_any(t, fv.EQUATION_OPERATORS)
            | t.rlike(fv.EQUATION_FUNCTION)
            | t.rlike(r"[_^{}\\]")
            | t.rlike(fv.CONDITIONAL_PROBABILITY)
        )
        return (
            (F.length(t) >= 3)
            & ~t.rlike(fv.EQUATION_CAPTION)
            & ~((F.size(words) > 5) & (prose / F.greatest(F.size(words), F.lit(1)) > 0.4))
            & (F.length(t) <= 500)
            & (F.size(words) <= 50)
            & signal
            & structure
        )

    return let(t, test)


def is_equation(c: Column, min_length: int = 5, max_length: int = 500) -> Column:
    """The operator-based test: a strong operator, few long words, no link, citation or caption."""
    t = strip(F.coalesce(c, F.lit("")))
    long_words = F.size(F.regexp_extract_all(t, F.lit(r"\b([a-zA-Z]{3,})\b"), F.lit(1)))
    return (
        F.length(t).between(min_length, max_length)
        & ~t.rlike(fv.EQUATION_LINK)
        & ~t.rlike(r"^\[\d+\]")
        & ~t.rlike(fv.EQUATION_CAPTION_WORD)
        & contains_any(t, fv.STRONG_OPERATORS)
        & (long_words <= 8)
        & (t.contains("\\") | t.rlike(f"[{fv.STRONG_GREEK}]") | (long_words <= 3))
    )


def equation_lines(line_rows: DataFrame) -> DataFrame:
    """Lines that either test calls an equation, with both answers."""
    out = line_rows.withColumn("by_structure", looks_like_math(F.col("line")))
    out = out.withColumn("by_operator", is_equation(F.col("line")))
    return out.where(F.col("by_structure") | F.col("by_operator"))


# ---- references ---------------------------------------------------------------------------


def _all_numbers(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(1))


def element_refs(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, element_type, number, n_refs): references to equations, tables and figures in a text."""

    def refs_of(kind: str, pattern: str) -> Column:
        return F.transform(
            _all_numbers(F.col(text), pattern),
            lambda n: F.struct(F.lit(kind).alias("element_type"), n.cast("bigint").alias("number")),
        )

    found = F.concat(*[refs_of(kind, p) for kind, p in fv.ELEMENT_REFERENCE.items()])
    refs = texts.select(key, F.explode(found).alias("r")).select(key, "r.element_type", "r.number")
    return refs.groupBy(key, "element_type", "number").agg(F.count("*").alias("n_refs"))


def requested_numbers(query: Column, kind: str) -> Column:
    """Sorted distinct numbers a question asks for: "tables 2 and 3", "figure 5a"."""
    q = F.lower(query)
    sep = r"\s*(?:,|and|&)\s*"
    pair, triple = rf"{kind}s?\s+(\d+){sep}(\d+)", rf"{kind}s?\s+(\d+){sep}(\d+){sep}(\d+)"
    groups = [(pair, 1), (pair, 2), (triple, 1), (triple, 2), (triple, 3), (rf"{kind}\s+(\d+)[a-z]?", 1)]
    found = F.concat(*[F.regexp_extract_all(q, F.lit(p), F.lit(g)) for p, g in groups])
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: n.cast("bigint"))))


# ---- markdown tables ------------------------------------------------------------------------


def _cells(line: Column) -> Column:
    """Cells of a table line: outer bars dropped, ends trimmed."""
    return F.transform(F.split(F.regexp_replace(strip(line), r"^\||\|$", ""), r"\|", -1), strip)


_SEPARATOR = r"^\s*\|[\s\-:|]+\|\s*$"


def markdown_tables(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per run of pipe lines: (key, table_no, rows, cols, headers, is_table, markdown).

    Runs are found inside each document by folding its lines, so nothing is shuffled.
    ``rows`` counts lines other than separators, ``headers`` are the cells of the first one,
    ``is_table`` asks for three lines and a separator.
    """
    parts = F.transform(
        lines(F.coalesce(F.col(text), F.lit(""))),
        lambda l: F.when(F.ltrim(l).startswith("|"), F.concat(l, F.lit("\n"))).otherwise(F.lit("\u0001")),
    )
    runs = F.filter(F.split(F.array_join(parts, ""), "\u0001+"), lambda r: r != "")
    df = docs.select(key, F.posexplode(F.transform(runs, lambda r: strip_chars(r, "\n"))).alias("table_no", "markdown"))
    all_lines = lines(F.col("markdown"))
    data = F.filter(all_lines, lambda l: ~l.rlike(_SEPARATOR))
    first = F.coalesce(F.get(data, F.lit(0)), F.lit(""))
    headers = F.filter(F.transform(F.split(first, r"\|", -1), strip), lambda c: c != "")
    return df.select(
        key,
        "table_no",
        F.size(data).alias("rows"),
        F.size(headers).alias("cols"),
        headers.alias("headers"),
        ((F.size(all_lines) >= 3) & F.exists(all_lines, lambda l: l.rlike(_SEPARATOR))).alias("is_table"),
        "markdown",
    )


_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_VALUE = rf"{_NUMBER}\s*±\s*{_NUMBER}"


def _tokens(cell: Column) -> Column:
    """Values of a cell; ``value ± deviation`` stays one token."""
    return F.regexp_extract_all(cell, F.lit(rf"({_VALUE}|\S+)"), F.lit(1))


def _is_value(token: Column) -> Column:
    return token.rlike(rf"^{_NUMBER}$") | token.rlike(rf"^{_VALUE}")


def unpacked_rows(cells: Column) -> Column:
    """Rows of a table line whose cells hold several values; one row when they do not."""

    def unpack(tokens: Column) -> Column:
        counts = F.transform(tokens, lambda t: F.size(F.filter(t, _is_value)))
        n = F.coalesce(F.array_max(counts), F.lit(0))

        def spread(k: Column) -> Column:
            columns = F.transform(
                tokens,
                lambda t: F.when(F.size(F.filter(t, _is_value)) >= k, F.filter(t, _is_value))
                .when(F.size(t) >= k, F.slice(t, 1, k))
                .otherwise(F.array_repeat(F.array_join(t, " "), k)),
            )
            return let(
                columns,
                lambda cs: F.transform(
                    F.sequence(F.lit(0), k - 1),
                    lambda i: F.transform(cs, lambda c: F.coalesce(F.get(c, i), F.lit(""))),
                ),
            )

        return let(n, lambda k: F.when(k > 1, spread(k)).otherwise(F.array(cells)))

    return let(F.transform(cells, _tokens), unpack)


def flat_headers(parent: Column, child: Column) -> Column:
    """Two header rows as one: parents cover the blank cells to their right, "Parent (Child)"."""
    filled = F.aggregate(
        parent,
        F.array().cast("array<string>"),
        lambda acc, c: F.array_append(acc, F.when(c != "", c).otherwise(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")))),
    )
    return F.zip_with(
        filled,
        child,
        lambda p, c: F.when(
            (F.coalesce(p, F.lit("")) != "") & (F.coalesce(c, F.lit("")) != "") & (F.lower(p) != F.lower(c)),
            F.concat(p, F.lit(" ("), c, F.lit(")")),
        )
        .when(F.coalesce(c, F.lit("")) != "", c)
        .otherwise(F.coalesce(p, F.lit(""))),
    )


def tidy_tables(tables: DataFrame, caption: str = "caption") -> DataFrame:
    """Body rows of markdown tables, one row each: (all key columns, header array, row_no, cells array).

    Prose and repeated-caption rows are dropped (unless fewer than two lines would stay), a second
    header row is folded into the first, and rows that pack several values are unpacked.
    """
    keys = [c for c in tables.columns if c not in ("markdown", caption)]
    phrase = squeeze(F.regexp_replace(F.coalesce(F.col(caption), F.lit("")), r"(?i)^Table\s+\d+[:.\s]*", ""))
    df = tables.withColumn("_cap", F.lower(F.array_join(F.slice(F.split(phrase, " "), 1, 8), " ")))
    raw = F.filter(lines(F.col("markdown")), lambda l: F.ltrim(l).startswith("|"))

    def is_prose(line: Column) -> Column:
        return F.exists(
            _cells(line),
            lambda c: ((word_count(c) > 15) & c.rlike(r"[.!?]$"))
            | ((F.length("_cap") > 10) & F.contains(F.lower(c), F.col("_cap"))),
        )

    def without_prose(r: Column) -> Column:
        kept = F.filter(r, lambda l: l.rlike(_SEPARATOR) | ~is_prose(l))
        return let(kept, lambda k: F.when(F.size(k) >= 2, k).otherwise(r))

    def padded(rows: Column) -> Column:
        width = F.array_max(F.transform(rows, F.size))
        fill = lambda r, w: F.concat(r, F.array_repeat(F.lit(""), F.greatest(w - F.size(r), F.lit(0))))
        return let(width, lambda w: F.transform(rows, lambda r: fill(r, w)))

    def split_header(rows: Column) -> Column:
        first, second = F.get(rows, F.lit(0)), F.get(rows, F.lit(1))
        filled = F.size(F.filter(second, lambda c: c != ""))
        labels = F.exists(second, lambda c: (c != "") & ~c.rlike(r"^[\d.\-+\s,%]*$"))
        two_level = (F.size(rows) > 1) & (filled > 0) & (filled < F.size(second)) & labels
        return let(
            two_level,
            lambda two: F.struct(
                F.when(two, flat_headers(first, second)).otherwise(first).alias("header"),
                F.flatten(
                    F.transform(F.slice(rows, F.when(two, 3).otherwise(2), F.size(rows)), unpacked_rows)
                ).alias("body"),
            ),
        )

    cells = let(raw, without_prose)
    cells = F.transform(F.filter(cells, lambda l: ~l.rlike(_SEPARATOR)), _cells)
    df = df.withColumn("_t", let(let(cells, padded), split_header))
    return df.select(*keys, F.col("_t.header").alias("header"), F.posexplode("_t.body").alias("row_no", "cells"))


# ---- excerpts and pages ---------------------------------------------------------------------


def excerpt_of(text: Column, term: Column, window: int = 320) -> Column:
    """Text around the first hit of a term (any case) with ellipses; the head when there is none."""

    def around(clean: Column) -> Column:
        n = F.length(clean)
        at = F.when(F.coalesce(term, F.lit("")) != "", F.instr(F.lower(clean), F.lower(term))).otherwise(0)
        start = F.greatest(F.lit(0), at - 1 - window // 2)
        end = F.least(n, at - 1 + F.length(term) + window // 2)
        hit = F.concat(
            F.when(start > 0, F.lit("... ")).otherwise(F.lit("")),
            strip_chars(clean.substr(start + 1, end - start), " ,.;"),
            F.when(end < n, F.lit(" ...")).otherwise(F.lit("")),
        )
        head = F.concat(strip(clean.substr(1, window)), F.when(n > window, F.lit(" ...")).otherwise(F.lit("")))
        return F.when(clean == "", F.lit("")).when(at > 0, hit).otherwise(head)

    return let(squeeze(F.coalesce(text, F.lit(""))), around)


def excerpts(matches: DataFrame, term: str = "term", text: str = "text", window: int = 320) -> DataFrame:
    return matches.withColumn("excerpt", excerpt_of(F.col(text), F.col(term), window))


def score_pages(pages: DataFrame, text: str = "text", images: str | None = None, figures: str | None = None) -> DataFrame:
    """Whether a page mentions a table, has figure words, its math density and its priority."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t)
    symbols = n - F.length(F.regexp_replace(t, f"[{fv.MATH_SYMBOLS}]", ""))
    density = F.when(n > 0, symbols / n).otherwise(0.0)
    figure_word = t.rlike(fv.FIGURE_WORD)
    priority = F.when(figure_word, 4.0).otherwise(0.0) + density * 20.0
    if figures:
        priority = priority + 3.0 * F.col(figures)
    if images:
        priority = priority + 2.0 * F.least(F.col(images), F.lit(3))
    return pages.withColumns(
        {
            "mentions_table": t.rlike(r"(?i)TABLE?\s+(\d+|[IVXLC]+)\b"),
            "has_figure_word": figure_word,
            "math_density": density,
            "priority": priority,
        }
    )


# ---- embedding texts, formulas ----------------------------------------------------------------


def _field(name: str, columns: list[str]) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in columns else F.lit("")


def embedding_text(chunks: DataFrame) -> DataFrame:
    """``embedding_text`` (all fields) and ``typed_text`` (one recipe per chunk type).

    Fields a chunk table lacks count as empty: section, caption, latex, description, variables,
    headers, keywords (space-joined), context, markdown.
    """
    f = {c: _field(c, chunks.columns) for c in (
        "chunk_type", "section", "caption", "latex", "description", "text", "variables", "headers",
        "keywords", "context", "markdown")}
    parts = [F.concat(F.lit(f"{label}: "), f[col]) for label, col in (
        ("type", "chunk_type"), ("section", "section"), ("caption", "caption"), ("latex", "latex"),
        ("description", "description"))]
    blank_to_null = F.when(strip(f["text"]) != "", f["text"])
    typed = (
        F.when(
            f["chunk_type"] == "equation",
            F.concat(F.lit("Equation: "), f["latex"], F.lit(" Variables: "), f["variables"], F.lit(" Context: "),
                     f["context"], F.lit(" Section: "), f["section"]),
        )
        .when(
            f["chunk_type"] == "table",
            F.concat(F.lit("Table: "), f["caption"], F.lit(" Headers: "), f["headers"], F.lit(" Data: "),
                     f["markdown"], F.lit(" Context: "), f["context"]),
        )
        .when(
            f["chunk_type"] == "figure",
            F.concat(F.lit("Figure: "), f["caption"], F.lit(" Context: "), f["context"], F.lit(" Section: "),
                     f["section"]),
        )
        .otherwise(F.concat(f["text"], F.lit(" Keywords: "), f["keywords"], F.lit(" Section: "), f["section"]))
    )
    return chunks.withColumn("embedding_text", squeeze(F.concat_ws("\n", *parts, blank_to_null))).withColumn(
        "typed_text", typed
    )


def variables_of(c: Column, limit: int | None = None) -> Column:
    """Distinct Greek letters, then single Latin letters; ``limit`` keeps the first ones."""
    greek = F.regexp_extract_all(c, F.lit(f"([{fv.VARIABLE_GREEK}])"), F.lit(1))
    latin = F.regexp_extract_all(c, F.lit(rf"(?<![{WORD}])([a-zA-Z])(?![{WORD}])"), F.lit(1))
    return first_of(F.concat(F.array_sort(F.array_distinct(greek)), F.array_sort(F.array_distinct(latin))), limit)


def equation_variables(equations: DataFrame, text: str = "text", limit: int | None = None) -> DataFrame:
    return equations.withColumn("variables", variables_of(F.col(text), limit))


def markdown_formulas(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, latex, is_block, context): block formulas with up to 60 characters before them, then inline ones."""
    t = F.coalesce(F.col(text), F.lit(""))
    block = r"(?s)\$\$(.+?)\$\$"
    pieces = F.split(t, block, -1)
    latex = F.transform(F.regexp_extract_all(t, F.lit(block), F.lit(1)), strip)

    def context(before: Column) -> Column:
        tail = strip(F.right(before, F.lit(80)))
        return F.right(F.replace(tail, F.lit("\n"), F.lit(" ")), F.lit(60))

    def with_context(l: Column, i: Column, ps: Column) -> Column:
        return F.struct(l.alias("latex"), F.lit(True).alias("is_block"), context(F.get(ps, i)).alias("context"))

    blocks = let(pieces, lambda ps: F.transform(latex, lambda l, i: with_context(l, i, ps)))
    inline = F.transform(
        F.regexp_extract_all(t, F.lit(r"(?<!\$)\$(?!\$)(.+?)(?<!\$)\$(?!\$)"), F.lit(1)),
        lambda l: F.struct(strip(l).alias("latex"), F.lit(False).alias("is_block"), F.lit("").alias("context")),
    )
    kept = F.concat(
        F.filter(blocks, lambda e: F.length(e["latex"]) > 2),
        F.filter(inline, lambda e: (F.length(e["latex"]) > 2) & e["latex"].rlike(r"[=+\-*/^_\\{}]|\\[a-zA-Z]")),
    )
    return docs.select(key, F.posexplode(kept).alias("pos", "f")).select(key, "pos", "f.*")


def markdown_title_authors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Title (first H1) and author line (first comma line) among the non-empty lines."""
    head = F.filter(F.transform(lines(F.coalesce(F.col(text), F.lit(""))), strip), lambda l: l != "")
    h1 = F.get(F.filter(head, lambda l: l.startswith("# ")), F.lit(0))
    author = F.filter(
        head,
        lambda l: l.contains(",")
        & ~l.startswith("#")
        & (F.length(l) < 300)
        & ~contains_any(F.lower(l), ["abstract", "doi", "http", "arxiv"]),
    )
    return docs.select(
        key,
        F.coalesce(strip(h1.substr(F.lit(3), F.length(h1))), F.lit("")).alias("title"),
        F.coalesce(F.get(author, F.lit(0)), F.lit("")).alias("authors"),
    )


# ---- facets ----------------------------------------------------------------------------------


def filter_papers(
    papers: DataFrame,
    *,
    top: int | None = None,
    min_relevance: float | None = None,
    source: str | None = None,
    year_from: int | None = None,
    year_to: int | None = None,
    min_citations: int = 0,
    author: str = "",
    sort: str = "relevance",
    rank: str = "rank",
) -> DataFrame:
    """Facets over a ranked paper table; ``top`` keeps the best ranked before the other facets.

    Ranks number the rows, so the top-n view is a filter and needs no sort.
    """
    df = papers
    if top is not None:
        df = df.where(F.col(rank) <= top)
    if min_relevance is not None:
        df = df.where(F.col("relevance") >= min_relevance)
    if source:
        df = df.where(F.array_contains(F.transform(F.split("source", ","), F.trim), source))
    year = F.when(F.col("published_date").rlike(r"^\d{4}"), F.substring("published_date", 1, 4).cast("int"))
    if year_from and year_from > 1950:
        df = df.where(F.coalesce(year, F.lit(0)) >= year_from)
    if year_to and year_to < date.today().year:
        df = df.where(F.coalesce(year, F.lit(9999)) <= year_to)
    if min_citations > 0:
        df = df.where(F.coalesce("citations", F.lit(0)) >= min_citations)
    if author.strip():
        wanted = author.strip().lower()
        df = df.where(F.exists("authors", lambda a: F.lower(a).contains(wanted)))
    order = {
        "relevance": [F.col(rank)],
        "citations": [F.col("citations").desc_nulls_last(), F.col(rank)],
        "newest": [F.col("published_date").desc_nulls_last(), F.col(rank)],
        "oldest": [F.col("published_date").asc_nulls_first(), F.col(rank)],
    }[sort]
    return df.orderBy(*order)
