"""Corpus-wide text cleaning. Every operator is one projection: no shuffle, no Python rows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions import fixed_values as fv
from litmill.functions.text import BLANKS, NOT_AFTER, NOT_BEFORE, WORD, first_per_key, let, lines, nfkc, squeeze, strip


@dataclass(frozen=True)
class CleanOptions:
    unicode: bool = True
    join_hyphens: bool = True
    drop_citations: bool = True
    drop_years: bool = True
    drop_bullets: bool = True
    drop_rulers: bool = True
    drop_display_latex: bool = False
    drop_inline_latex: bool = False
    squeeze_blank_lines: bool = True


def cleaned(c: Column, o: CleanOptions = CleanOptions()) -> Column:
    """Text without NULs, citations, bare years, bullets and rulers, and with squeezed blanks."""
    c = F.coalesce(c, F.lit(""))
    c = F.regexp_replace(F.replace(c, F.lit("\u0000"), F.lit("")), "\r\n?", "\n")
    if o.unicode:
        c = nfkc(c)
    if o.join_hyphens:
        c = F.regexp_replace(c, rf"([{WORD}])-\n([{WORD}])", "$1$2")
    removals = [
        (o.drop_citations, fv.NUMERIC_CITATION, ""),
        (o.drop_years, fv.YEAR_IN_PARENTHESES, ""),
        (o.drop_bullets, fv.BULLETS, ""),
        (o.drop_rulers, fv.RULER, " "),
        (o.drop_display_latex, fv.DISPLAY_LATEX[0], " "),
        (o.drop_display_latex, fv.DISPLAY_LATEX[1], " "),
        (o.drop_inline_latex, fv.INLINE_LATEX, " "),
        (True, r"[ \t]+", " "),
        (o.squeeze_blank_lines, r"\n{3,}", "\n\n"),
    ]
    for wanted, pattern, by in removals:
        if wanted:
            c = F.regexp_replace(c, pattern, by)
    return strip(c)


def clean_text(docs: DataFrame, options: CleanOptions = CleanOptions(), text: str = "text") -> DataFrame:
    return docs.withColumn(text, cleaned(F.col(text), options))


def without_back_matter(c: Column, headings: list[str] | None = None) -> Column:
    """The text up to the first short line that is a back-matter heading."""
    names = "|".join(re.escape(h) for h in headings or fv.BACK_MATTER_HEADINGS)
    stop = rf"^(\d+\.?\s*)?({names})$"

    def is_stop(line: Column) -> Column:
        key = F.lower(strip(line))
        return F.length(key).between(1, 59) & key.rlike(stop)

    def cut(parts: Column) -> Column:
        first = F.array_position(F.transform(parts, is_stop), F.lit(True))
        return F.array_join(F.when(first > 0, F.slice(parts, F.lit(1), first.cast("int") - 1)).otherwise(parts), "\n")

    return strip(let(lines(c), cut))


def drop_back_matter(docs: DataFrame, headings: list[str] | None = None, text: str = "text") -> DataFrame:
    return docs.withColumn(text, without_back_matter(F.col(text), headings))


def expanded(c: Column, mapping: dict[str, str] | None = None) -> Column:
    """Abbreviations replaced by their full forms: whole words, any case, longest key first."""
    for key, full in sorted((mapping or fv.ABBREVIATIONS).items(), key=lambda kv: -len(kv[0])):
        c = F.regexp_replace(c, rf"(?iu){NOT_BEFORE}{re.escape(key)}{NOT_AFTER}", full.replace("$", r"\$"))
    return c


def expand_terms(docs: DataFrame, mapping: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    return docs.withColumn(text, expanded(F.col(text), mapping))


def preprocess(docs: DataFrame, options: CleanOptions = CleanOptions(), text: str = "text") -> DataFrame:
    """Clean, cut the back matter, expand abbreviations."""
    return docs.withColumn(text, expanded(without_back_matter(cleaned(F.col(text), options))))


# ---- small column normalisers -----------------------------------------------------------


def truncated(c: Column, max_chars: int) -> Column:
    return F.when(F.length(c) <= max_chars, c).otherwise(
        F.concat(F.substring(c, 1, max_chars), F.lit(fv.TRUNCATION_MARK))
    )


def without_fences(c: Column) -> Column:
    c = F.regexp_replace(strip(c), r"^```[a-zA-Z]*\n?", "")
    return strip(F.regexp_replace(c, r"\n?```$", ""))


def html_escaped(c: Column) -> Column:
    for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def bold_to_html(c: Column) -> Column:
    return F.regexp_replace(c, r"\*\*(.+?)\*\*", "<b>$1</b>")


NORMALISERS = {
    "whitespace": squeeze,
    "code_fences": without_fences,
    "html_escape": html_escaped,
    "bold_html": bold_to_html,
}


def normalize_columns(df: DataFrame, ops: dict[str, list[str | int]]) -> DataFrame:
    """``ops``: column -> normalisers in order; an integer truncates to that many characters."""
    for name, steps in ops.items():
        c = F.col(name)
        for step in steps:
            c = truncated(c, step) if isinstance(step, int) else NORMALISERS[step](c)
        df = df.withColumn(name, c)
    return df


# ---- repeated lines, sentences, phrases ----------------------------------------------------


def sentences_of(c: Column) -> Column:
    """Cut after ``.``, ``!`` or ``?`` followed by whitespace."""
    return F.split(c, r"(?<=[.!?])\s+", -1)


def dedup_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Keep the first of equal lines (ends trimmed) and every blank line."""
    kept = first_per_key(lines(F.col(text)), strip, lambda x: strip(x) == "")
    return docs.withColumn(text, F.array_join(kept, "\n"))


def dedup_sentences(docs: DataFrame, text: str = "text", min_chars: int = 10) -> DataFrame:
    """Keep the first of equal sentences, any case; shorter ones always stay."""
    kept = first_per_key(
        sentences_of(F.col(text)), lambda x: F.lower(strip(x)), lambda x: F.length(strip(x)) < min_chars
    )
    return docs.withColumn(text, F.array_join(kept, " "))


def without_stock_repeats(c: Column) -> Column:
    """A stock sentence about an element or the document that is repeated at once stays one time."""
    c = F.regexp_replace(
        c, r"(?i)((?:Equation|Table|Figure)\s+\d+\s+(?:is|are|shows|demonstrates)\s+[^.]+\.)\s*\1+", "$1"
    )
    return F.regexp_replace(c, r"(?i)(The document (?:contains|has|includes)[^.]+\.)\s*\1+", "$1")


_MATH_OR_PROSE = r"(?s)(\$\$.*?\$\$|\$[^$\n]+?\$|[^$]+|\$)"


def on_prose(c: Column, change) -> Column:
    """Apply ``change`` to the parts of a text outside ``$...$`` and ``$$...$$``."""
    parts = F.regexp_extract_all(c, F.lit(_MATH_OR_PROSE), F.lit(1))
    return F.array_join(
        F.transform(parts, lambda p: F.when(p.startswith("$") & (F.length(p) > 1), p).otherwise(change(p))), ""
    )


def without_adjacent_repeats(c: Column) -> Column:
    """``Q Q`` and ``the model the model`` become one; formulas are left alone."""

    def collapse(p: Column) -> Column:
        p = F.regexp_replace(p, r"\b([A-Za-z0-9_\-.]{1,20})(?:\s+\1)++\b", "$1")
        p = F.regexp_replace(p, r"(?<![\w$])([A-Z])\s+\1(?![\w$])", "$1")
        return F.regexp_replace(p, r"\b((?:\S+\s+){1,5}\S+)\s+\1\b", "$1")

    return on_prose(c, collapse)


def without_doubled_half(c: Column) -> Column:
    """Equation text that was scanned twice keeps one copy."""

    def halves(s: Column) -> Column:
        n = F.length(s)
        mid = F.floor(n / 2).cast("int")
        a = F.trim(s.substr(F.lit(1), mid))
        b = F.trim(s.substr(mid + 1, n))
        start = F.least(F.lit(8), F.length(a))
        doubled = (F.length(a) > 4) & (F.startswith(b, a.substr(F.lit(1), start)) | F.contains(b, a))
        lo, hi = F.floor(n / 3).cast("int"), F.floor(n * 2 / 3).cast("int") - 1
        cuts = F.filter(
            F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>")),
            lambda k: (k > 5)
            & F.startswith(s.substr(k + 1, n), s.substr(F.lit(1), F.greatest(F.lit(4), k - 2))),
        )
        cut = F.try_element_at(cuts, F.lit(1))
        return F.when(doubled, a).when(cut.isNotNull(), s.substr(F.lit(1), cut)).otherwise(s)

    flat = F.regexp_replace(F.regexp_replace(strip(c), r"[\n\r\t]+", " "), " {2,}", " ")
    return F.when(F.length(c) < 6, c).otherwise(let(flat, halves))


def collapse_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn(text, without_adjacent_repeats(without_stock_repeats(F.col(text))))


def strip_prompt_leakage(df: DataFrame, text: str = "text") -> DataFrame:
    """Drop prompt labels and instruction blocks, in list order, then squeeze blank lines."""
    c = F.col(text)
    for pattern in fv.PROMPT_ARTEFACTS:
        c = F.regexp_replace(c, f"(?is){pattern}", "")
    return df.withColumn(text, F.regexp_replace(strip(c), r"\n{3,}", "\n\n"))


# ---- answers ---------------------------------------------------------------------------------


def tidy_math_delimiters(c: Column) -> Column:
    """Repair ``$`` delimiters: no empty blocks, display formulas on their own lines, none nested."""
    c = F.regexp_replace(c, r"\${3,}", r"\$\$")
    c = F.regexp_replace(c, r"\$\$\s*\n?\s*\$\$", "")
    c = F.regexp_replace(c, r"([^\n])\$\$([^$])", "$1\n\\$\\$$2")
    c = F.regexp_replace(c, r"([^$])\$\$([^\n$])", "$1\\$\\$\n$2")
    parts = F.regexp_extract_all(c, F.lit(r"(?s)(\$\$.*?\$\$|\$[^$]{1,500}?\$|[^$]+|\$)"), F.lit(1))

    def fix(p: Column) -> Column:
        inner = F.replace(p, F.lit("$"), F.lit(""))
        display = p.startswith("$$") & (F.length(p) > 4)
        inline = p.startswith("$") & (F.length(p) > 2)
        return (
            F.when(display, F.concat(F.lit("$$"), inner, F.lit("$$")))
            .when(inline & p.contains("\n"), F.concat(F.lit("$$"), strip(inner), F.lit("$$")))
            .otherwise(p)
        )

    return F.regexp_replace(F.array_join(F.transform(parts, fix), ""), r"\n{3,}", "\n\n")


def answer_cleaned(c: Column) -> Column:
    """Drop template remains and doubled tokens of an answer; formulas stay renderable."""
    for pattern, by in fv.ANSWER_LABELS:
        c = F.regexp_replace(c, pattern, by)
    c = F.regexp_replace(F.regexp_replace(c, "\r", "\n"), r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"[ \t]{2,}", " ")
    return strip(tidy_math_delimiters(without_adjacent_repeats(c)))


def summary_cleaned(c: Column) -> Column:
    """LaTeX commands outside formulas go, and so do repeated sentences."""
    c = F.regexp_replace(c, r"(?is)\bTechnical Details\b.*$", "")
    c = on_prose(c, lambda p: F.regexp_replace(F.regexp_replace(p, r"\\[A-Za-z]+\*?", ""), r"[_^{}]", ""))
    stripped = F.filter(F.transform(sentences_of(c), strip), lambda x: x != "")
    return strip(F.array_join(first_per_key(stripped, lambda x: F.lower(squeeze(x)), lambda x: F.lit(False)), " "))


def without_element_text(c: Column, element_texts: Column) -> Column:
    """Raw element texts (over 10 characters) and their labels are taken out of an answer."""
    c = F.regexp_replace(c, fv.SYMBOL_RUN, "")
    c = F.aggregate(
        F.coalesce(element_texts, F.array().cast("array<string>")), c, lambda acc, t: F.replace(acc, t, F.lit(""))
    )
    c = F.regexp_replace(c, fv.EMPTY_LABEL, "")
    return strip(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


def clean_answers(answers: DataFrame, elements: DataFrame, text: str = "text") -> DataFrame:
    """Answers (doc_id, text) cleaned, with the texts of the elements (doc_id, text) of their document removed.

    Element texts are distinct per document before they meet the answers.
    """
    listed = (
        elements.select("doc_id", strip(F.col("text")).alias("t"))
        .where(F.length("t") > 10)
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_set("t")).alias("element_texts"))
    )
    out = answers.withColumn(text, answer_cleaned(F.coalesce(F.col(text), F.lit(""))))
    out = out.join(listed, "doc_id", "left")
    out = out.withColumn(text, without_element_text(F.col(text), F.col("element_texts")))
    return out.withColumn(text, summary_cleaned(F.col(text))).drop("element_texts")
