"""Canonical keys of names and titles, and document metadata read from the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions import fixed_values as fv
from litmill.functions.text import WORD, contains_any, let, lines, nfkc, squeeze, strip, strip_chars


def canonical_key_of(c: Column) -> Column:
    """Lower-case ASCII key of a name without brackets and leading articles."""
    c = F.lower(F.translate(nfkc(F.coalesce(c, F.lit(""))), "–—", "--"))
    c = squeeze(F.regexp_replace(F.regexp_replace(c, r"[()\[\]{}]", " "), r"[^a-z0-9+\-. ]+", " "))
    return F.regexp_replace(c, r"^(?:(?:the|a|an)(?: |$))+", "")


def canonical_key(names: DataFrame, name: str = "name", out: str = "key") -> DataFrame:
    return names.withColumn(out, canonical_key_of(F.col(name)))


def title_key_of(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"[^{WORD}\s]", ""))


def title_key(papers: DataFrame, title: str = "title", out: str = "title_key") -> DataFrame:
    return papers.withColumn(out, title_key_of(F.col(title)))


# ---- metadata ----------------------------------------------------------------------------


def extract_metadata(docs: DataFrame, text: str = "text", filename: str = "filename") -> DataFrame:
    """arXiv id (from the file name), title, authors, affiliations, year and abstract of every document.

    The text is read as its first page: whitespace is squeezed and sentences take the part of lines.
    """
    page = squeeze(F.coalesce(F.col(text), F.lit("")))
    df = docs.withColumn("_page", page)
    df = df.withColumn("_lines", F.filter(F.split("_page", r"(?<=[.!?])\s+", -1), lambda x: F.trim(x) != ""))
    arxiv = F.regexp_extract(F.coalesce(F.col(filename), F.lit("")), fv.ARXIV_ID, 0)
    titles = F.slice(
        F.filter(
            "_lines", lambda x: ~F.lower(x).rlike(fv.TITLE_SKIP) & ~x.contains("@") & (F.length(x) >= 15)
        ),
        1,
        2,
    )
    title = F.split(F.array_join(titles, " "), r"(?i)\bauthors?\b")[0]
    author_text = squeeze(F.regexp_replace(F.array_join(F.slice("_lines", 2, 5), " "), r"[†‡⋆*]+", " "))
    names = F.regexp_extract_all(author_text, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z\-]+){1,3})\b"), F.lit(1))
    names = F.array_distinct(
        F.filter(names, lambda n: ~F.arrays_overlap(F.split(n, r"\s+"), F.array(*map(F.lit, fv.NOT_A_NAME))))
    )
    year = F.regexp_extract("_page", r"\b(19\d{2}|20\d{2})\b", 1)
    abstract = F.regexp_extract(
        "_page", r"(?is)\bAbstract\b[:\s]*(.{80,2500}?)(?:\bIntroduction\b|\b1\s+Introduction\b)", 1
    )
    return df.withColumns(
        {
            "arxiv_id": arxiv,
            "title": squeeze(strip_chars(title, " ,;-")),
            "authors": names,
            "affiliations": F.filter("_lines", lambda x: x.rlike(fv.AFFILIATION)),
            "year": F.when(year != "", year)
            .when(arxiv != "", (F.lit(2000) + arxiv.substr(1, 2).cast("int")).cast("string"))
            .otherwise(""),
            "abstract": F.when(abstract != "", squeeze(abstract)).otherwise(
                strip(F.array_join(F.slice("_lines", 1, 4), " "))
            ),
        }
    ).drop("_page", "_lines")


# ---- titles ----------------------------------------------------------------------------------


def first_line(c: Column) -> Column:
    """The first line of a field, whitespace squeezed."""
    return squeeze(lines(F.coalesce(c, F.lit("")))[0])


def title_score(t: Column) -> Column:
    """How much a line looks like a paper title; section headings and prose score low."""
    bonus = lambda cond, points: F.when(cond, points).otherwise(0)
    score = (
        bonus(t.contains(":"), 5)
        + bonus(t.rlike(r"\b[A-Z]{2,}\b"), 4)
        + bonus(t.rlike(r"[A-Z][a-z]+\s+[A-Z][a-z]+"), 3)
        + bonus(t.rlike(fv.TITLE_PROSE), -8)
        + bonus(F.length(t) < 15, -3)
        + bonus(F.length(t) > 250, -2)
        + bonus(t.rlike(r"(?i)^(Introduction|Abstract|Methodology|Results|Conclusion)\b"), -10)
    )
    return F.when((t == "") | (t == fv.NOT_FOUND), F.lit(-99)).otherwise(score)


def _plain_line(t: Column) -> Column:
    rejected = F.lit(False)
    for p in fv.TITLE_REJECTS:
        rejected = rejected | t.rlike(p)
    return (
        (t != "")
        & (F.lower(t) != fv.NOT_FOUND.lower())
        & F.length(t).between(8, 300)
        & ~rejected
        & ~contains_any(F.lower(t), fv.LINK_MARKS)
    )


def is_title(t: Column) -> Column:
    return _plain_line(t) & ~contains_any(F.lower(t), ["abstract", "introduction"]) & (title_score(t) >= -3)


def titles_in(block: Column, min_score: int) -> Column:
    """Title-like lines (12 to 180 characters) of a text."""
    return F.filter(
        F.transform(lines(F.coalesce(block, F.lit(""))), squeeze),
        lambda x: F.length(x).between(12, 180) & is_title(x) & (title_score(x) >= min_score),
    )


def _best(titles: Column, score) -> Column:
    """Highest score wins, the earlier one on a tie."""
    ranked = F.array_sort(F.transform(titles, lambda t, i: F.struct((-score(t)).alias("s"), i.alias("i"), t.alias("t"))))
    return F.get(ranked, F.lit(0))["t"]


def clean_authors(c: Column) -> Column:
    """An author line, or "Not found" when it is legal text, an affiliation, prose or has no name."""
    a = first_line(c)
    low = F.lower(a)
    names = F.array_except(
        F.regexp_extract_all(a, F.lit(r"\b([A-Z][a-z]{2,})\b"), F.lit(1)), F.array(*map(F.lit, fv.INSTITUTION_WORDS))
    )
    spaces = F.length(a) - F.length(F.replace(a, F.lit(" "), F.lit("")))
    good = (
        F.length(a).between(3, 350)
        & (low != fv.NOT_FOUND.lower())
        & ~contains_any(low, fv.AUTHOR_REJECT_MARKS)
        & ~a.rlike(fv.AUTHOR_REJECTS)
        & ~a.rlike(fv.AFFILIATION_ONLY)
        & ~a.rlike(fv.EMAIL_ONLY)
        & ~((spaces > 12) & low.rlike(r"\b(is|are|has|have|was|were|the|a\s|an\s|we\s|our\s|this\s)\b"))
        & (F.size(names) > 0)
    )
    return F.when(good, a).otherwise(F.lit(fv.NOT_FOUND))


def resolve_titles(candidates: DataFrame) -> DataFrame:
    """Best title and author line per paper.

    Input: paper_id, primary_title, fallback_title, primary_authors, fallback_authors, abstract,
    introduction. One projection: scored candidates, then any plain line, then the first
    title-like line of abstract or introduction.
    """
    intro = F.coalesce(F.col("introduction"), F.lit(""))
    from_abstract = F.coalesce(_best(titles_in(F.col("abstract"), 2), title_score), F.lit(""))
    from_intro = F.coalesce(_best(titles_in(intro, 3), title_score), F.lit(""))
    fields = F.array(first_line(F.col("primary_title")), first_line(F.col("fallback_title")), from_abstract, from_intro)
    scored = let(fields, lambda a: _best(F.filter(a, is_title), title_score))
    longest = let(fields, lambda a: _best(F.filter(a, _plain_line), F.length))

    def usable(block: Column) -> Column:
        def ok(x: Column) -> Column:
            low = F.lower(x)
            bad_start = F.lit(False)
            for p in fv.TITLE_SKIP_PREFIXES:
                bad_start = bad_start | low.startswith(p)
            return (
                F.length(x).between(20, 200)
                & ~bad_start
                & ~contains_any(low, fv.TITLE_SKIP_CONTAINS)
                & x.rlike(r"[A-Z][a-z]{2,}")
            )

        return F.get(F.filter(F.transform(lines(F.coalesce(block, F.lit(""))), squeeze), ok), F.lit(0))

    title = F.coalesce(
        scored, longest, usable(F.col("abstract")), usable(intro), F.lit(fv.NOT_FOUND)
    )
    primary = clean_authors(F.col("primary_authors"))
    authors = F.when(primary != fv.NOT_FOUND, primary).otherwise(clean_authors(F.col("fallback_authors")))
    return candidates.select("paper_id", title.alias("title"), authors.alias("authors"))
