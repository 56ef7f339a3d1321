"""Row-expanding chunkers. A document is one row, so every chunker works inside rows: nothing is shuffled
until a ranking asks for it. Folds over paragraphs are higher-order functions; the two order-dependent
chunkers that need vectors or recursion get a small Arrow helper.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litmill.functions import fixed_values as fv
from litmill.functions.text import first_of, let, lines, squeeze, strip, word_count, words
from litmill.operators.cleaning import cleaned, expanded, without_back_matter
from litmill.operators.fusion import rank_chunks
from litmill.operators.lexical import counted_in_place
from litmill.operators.lines import content_type_of, variables_of
from litmill.operators.vectors import hash_vector

_NONE = "array<string>"


def _strings() -> Column:
    return F.array().cast(_NONE)


def _exploded(docs: DataFrame, chunks: Column, key: str) -> DataFrame:
    return docs.select(key, F.posexplode(chunks).alias("chunk_no", "text"))


# ---- pages and sections ----------------------------------------------------------------------------


def split_pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, page_num, text): bodies after page markers; the whole text is page 1 without markers."""
    t = F.coalesce(F.col(text), F.lit(""))
    numbers = F.regexp_extract_all(t, F.lit(fv.PAGE_MARKER), F.lit(1))
    bodies = F.split(t, fv.PAGE_MARKER, -1)
    pages = F.zip_with(
        numbers,
        F.slice(bodies, F.lit(2), F.greatest(F.size(bodies) - 1, F.lit(0))),
        lambda n, b: F.struct(n.cast("int").alias("page_num"), strip(b).alias("text")),
    )
    whole = F.array(F.struct(F.lit(1).alias("page_num"), strip(t).alias("text")))
    rows = docs.select(key, F.explode(F.when(F.size(numbers) > 0, pages).otherwise(whole)).alias("p"))
    return rows.select(key, "p.page_num", "p.text").where("text != ''")


_PAGE_SECTION = (
    "(?im)" + "|".join(rf"(?:^\s*{h}\s*$)" for h in fv.PAGE_SECTION_HEADINGS) + r"|(?:^\s*\d+(?:\.\d+)*\s+.+$)"
)


def split_sections(pages: DataFrame, drop_references: bool = True) -> DataFrame:
    """(…, section_no, title, text): sections of each page by heading lines; "page" without headings."""
    keys = [c for c in pages.columns if c != "text"]
    titles = F.transform(F.regexp_extract_all("text", F.lit(f"({_PAGE_SECTION})"), F.lit(0)), squeeze)
    bodies = F.split("text", _PAGE_SECTION, -1)
    found = F.filter(
        F.zip_with(
            titles,
            F.slice(bodies, F.lit(2), F.greatest(F.size(bodies) - 1, F.lit(0))),
            lambda t, b: F.struct(t.alias("title"), strip(b).alias("text")),
        ),
        lambda s: s["text"] != "",
    )
    whole = F.array(F.struct(F.lit("page").alias("title"), strip(F.col("text")).alias("text")))
    rows = pages.select(*keys, F.posexplode(let(found, lambda s: F.when(F.size(s) > 0, s).otherwise(whole))).alias("section_no", "s"))
    rows = rows.select(*keys, "section_no", "s.title", "s.text")
    return rows.where(F.lower(F.trim("title")) != "references") if drop_references else rows


# ---- paragraph windows ----------------------------------------------------------------------------------


def paragraphs_of(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n\s*\n+", -1), strip), lambda p: p != "")


def _tail(items: Column, limit: int, at_least_one: bool) -> Column:
    """Trailing items of (text, words) that fit into ``limit`` words."""
    start = F.struct(
        F.array().cast("array<struct<text:string,words:int>>").alias("kept"), F.lit(0).alias("words"), F.lit(False).alias("full")
    )

    def step(acc: Column, p: Column) -> Column:
        over = acc["words"] + p["words"] > limit
        stop = acc["full"] | (over & (F.size(acc["kept"]) > 0) if at_least_one else over)
        return F.struct(
            F.when(stop, acc["kept"]).otherwise(F.concat(F.array(p), acc["kept"])).alias("kept"),
            F.when(stop, acc["words"]).otherwise(acc["words"] + p["words"]).alias("words"),
            stop.alias("full"),
        )

    return F.aggregate(F.reverse(items), start, step, lambda acc: acc["kept"])


def _packed(items: Column, size: int, overlap: int, at_least_one: bool, oversized: int | None, whole: bool) -> Column:
    """Items (text, words) packed to ``size`` words with trailing overlap.

    Items over ``oversized`` words are cut by word steps; with ``whole`` an item over ``size`` that meets an
    empty buffer becomes a chunk of its own.
    """
    pair = "array<struct<text:string,words:int>>"
    start = F.struct(_strings().alias("out"), F.array().cast(pair).alias("cur"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x["words"])
    joined = lambda xs: strip(F.array_join(F.transform(xs, lambda x: x["text"]), "\n\n"))

    def cut(p: Column) -> Column:
        step = max(1, size - overlap)
        return let(
            words(p["text"]),
            lambda w: F.transform(
                F.sequence(F.lit(0), F.size(w) - 1, F.lit(step)), lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " ")
            ),
        )

    def step(acc: Column, p: Column) -> Column:
        empty = F.size(acc["cur"]) == 0
        flush = ~empty & (total(acc["cur"]) + p["words"] > size)
        kept = _tail(acc["cur"], overlap, at_least_one) if overlap > 0 else F.array().cast(pair)
        added = F.struct(
            F.when(flush, F.array_append(acc["out"], joined(acc["cur"]))).otherwise(acc["out"]).alias("out"),
            F.array_append(F.when(flush, kept).otherwise(acc["cur"]), p).alias("cur"),
        )
        out = None
        if oversized is not None:
            out = F.when(p["words"] > oversized, F.struct(F.concat(acc["out"], cut(p)).alias("out"), acc["cur"].alias("cur")))
        if whole:
            alone = F.struct(F.array_append(acc["out"], p["text"]).alias("out"), acc["cur"].alias("cur"))
            out = F.when(empty & (p["words"] > size), alone)
        return out.otherwise(added)

    return F.aggregate(
        items,
        start,
        step,
        lambda acc: F.when(F.size(acc["cur"]) > 0, F.array_append(acc["out"], joined(acc["cur"]))).otherwise(acc["out"]),
    )


def _sized(items: Column) -> Column:
    return F.transform(items, lambda p: F.struct(p.alias("text"), word_count(p).alias("words")))


def window_chunks(sections: DataFrame, target_words: int = 900, overlap_words: int = 150) -> DataFrame:
    """(keys, window_no, text): paragraphs packed to ``target_words``, whole trailing paragraphs repeated."""
    keys = [c for c in sections.columns if c != "text"]
    packed = _packed(_sized(paragraphs_of(F.col("text"))), target_words, overlap_words, True, int(target_words * 1.5), False)
    return sections.select(*keys, F.posexplode(packed).alias("window_no", "text"))


def custom_chunks(docs: DataFrame, target_words: int = 900, overlap_words: int = 150, drop_references: bool = True, key: str = "doc_id") -> DataFrame:
    """(key, chunk_no, chunk_id, text): pages, sections, windows; the id names chunk, page and section."""
    rows = window_chunks(split_sections(split_pages(docs, key), drop_references), target_words, overlap_words)
    w = Window.partitionBy(key).orderBy("page_no", "section_no", "window_no")
    # Pages of a document come in marker order; equal numbers keep their sections apart.
    rows = rows.withColumn("page_no", F.col("page_num")).withColumn("chunk_no", F.row_number().over(w) - 1)
    chunk_id = F.concat(
        F.lpad((F.col("chunk_no") + 1).cast("string"), 5, "0"), F.lit("|p"), F.col("page_num").cast("string"), F.lit("|"), F.trim(F.substring("title", 1, 30))
    )
    return rows.select(key, "chunk_no", chunk_id.alias("chunk_id"), "text")


def layout_chunks(docs: DataFrame, size: int = 1500, overlap: int = 300, min_words: int = 15, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Segments at headings, ``$$`` blocks, tables and blank lines, packed to ``size`` words."""
    boundary = r"(?:^|\n)(?=#{1,4}\s)|(?:^|\n)(?=\$\$)|(?<=\$\$)\n|(?:^|\n)(?=\|.*\|.*\n)|\n{2,}"
    segments = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), boundary, -1), strip), lambda s: s != "")
    packed = _packed(_sized(segments), size, overlap, False, None, True)
    return _exploded(docs, F.filter(packed, lambda c: word_count(c) >= min_words), key)


# ---- character chunkers --------------------------------------------------------------------------------------


def _sliding(t: Column, size: int, step: int, limit: int | None, min_chars: int) -> Column:
    starts = F.when(F.length(t) > 0, F.sequence(F.lit(0), F.length(t) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(starts, lambda s: strip(F.substring(t, s + 1, F.lit(size))))
    return first_of(F.filter(pieces, lambda c: F.length(c) >= min_chars), limit)


def sliding_chunks(docs: DataFrame, size: int = 2800, step: int = 900, limit: int | None = None, min_chars: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_no, text): windows of ``size`` characters every ``step`` over the whole text; ``limit`` keeps the first ones."""
    return _exploded(docs, let(strip(F.coalesce(F.col(text), F.lit(""))), lambda t: _sliding(t, size, step, limit, min_chars)), key)


_SECTION_UNION = "|".join(h.replace(" ", r"\s+") for h in fv.SECTION_HEADINGS)
_SECTION_LINE = rf"(?im)^(?:\d+\.|[IVX]+\.|[IVX]+\b|\d+\b)?\s*({_SECTION_UNION})\s*$"
_SECTION_STEM = "(?i)^(" + "|".join(fv.SECTION_STEMS) + ")"


def _section_packed(t: Column, size: int, overlap: int, min_chars: int) -> Column:
    heads = F.regexp_extract_all(t, F.lit(_SECTION_LINE), F.lit(1))
    bodies = F.split(t, _SECTION_LINE, -1)
    parts = F.flatten(let(heads, lambda h: F.transform(bodies, lambda b, i: F.array(b, F.coalesce(F.get(h, i), F.lit(""))))))
    parts = F.transform(F.filter(parts, lambda p: p != ""), strip)
    start = F.struct(_strings().alias("out"), F.lit(None).cast("string").alias("cur"))

    def step(acc: Column, p: Column) -> Column:
        heading = (F.length(p) < 60) & p.rlike(_SECTION_STEM)
        piece = F.when(heading, F.concat(F.lit("\n\n## "), p, F.lit("\n\n"))).otherwise(p)
        joined = F.when(acc["cur"].isNull(), piece).otherwise(F.concat(acc["cur"], F.lit(" "), piece))
        full = strip(joined)
        emit = ~heading & (F.length(full) >= size)
        tail = strip(F.right(full, F.lit(overlap))) if overlap > 0 else F.lit("")
        return F.struct(
            F.when(emit, F.array_append(acc["out"], full)).otherwise(acc["out"]).alias("out"),
            F.when(emit, F.when(tail != "", tail)).otherwise(joined).alias("cur"),
        )

    chunks = F.aggregate(
        parts, start, step, lambda acc: F.when(acc["cur"].isNotNull(), F.array_append(acc["out"], strip(acc["cur"]))).otherwise(acc["out"])
    )
    return F.filter(chunks, lambda c: F.length(strip(c)) >= min_chars)


def section_pack_chunks(docs: DataFrame, size: int = 3500, overlap: int = 450, min_chars: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sections packed to ``size`` characters; the tail of a chunk starts the next one."""
    return _exploded(docs, let(strip(F.coalesce(F.col(text), F.lit(""))), lambda t: _section_packed(t, size, overlap, min_chars)), key)


def _page_merged(t: Column, min_chars: int, limit: int) -> Column:
    pages = F.filter(F.transform(F.split(t, fv.PAGE_LINE, -1), strip), lambda p: p != "")
    start = F.struct(_strings().alias("out"), F.lit("").alias("buf"))

    def step(acc: Column, p: Column) -> Column:
        buf = acc["buf"]
        merge = (buf != "") & (F.length(buf) + F.length(p) < limit)
        emit = (buf != "") & ~merge & (F.length(strip(buf)) >= min_chars)
        return F.struct(
            F.when(emit, F.array_append(acc["out"], strip(buf))).otherwise(acc["out"]).alias("out"),
            F.when(merge, F.concat(buf, F.lit("\n\n"), p)).otherwise(p).alias("buf"),
        )

    return F.aggregate(
        pages, start, step, lambda acc: F.when(F.length(strip(acc["buf"])) >= min_chars, F.array_append(acc["out"], strip(acc["buf"]))).otherwise(acc["out"])
    )


def page_merge_chunks(docs: DataFrame, min_chars: int = 150, limit: int = 4000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Neighbouring pages merged while they stay under ``limit`` characters."""
    return _exploded(docs, let(strip(F.coalesce(F.col(text), F.lit(""))), lambda t: _page_merged(t, min_chars, limit)), key)


def boundary_chunks(docs: DataFrame, size: int = 8000, overlap: int = 500, max_chunks: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_no, start, stop, text): chunks that end at a paragraph or sentence in their second half.

    They cover the whole text; ``max_chunks`` keeps the first ones. The last chunk is the first one that
    reaches the end.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    row = "array<struct<start:int,stop:int>>"

    def last_break(body: Column, lo: Column, end: Column, mark: str) -> Column:
        part = F.substring(body, lo + 1, end - lo)
        r = F.instr(F.reverse(part), mark[::-1])
        return F.when(r > 0, lo + F.length(part) - (r - 1))

    def cut(body: Column) -> Column:
        n = F.length(body)
        turns = F.ceil(n / (size // 2 - min(overlap, size // 4))).cast("int") if max_chunks is None else F.lit(max_chunks)
        first = F.struct(F.array().cast(row).alias("out"), F.lit(0).alias("at"), F.lit(False).alias("done"))

        def step(acc: Column, _: Column) -> Column:
            at = acc["at"]
            hard = F.least(at + size, n)
            soft = F.coalesce(last_break(body, at + size // 2, hard, "\n\n"), last_break(body, at + size // 2, hard, ". "), hard)
            end = F.when(hard < n, soft).otherwise(hard)
            return F.when(acc["done"], acc).otherwise(
                F.struct(
                    F.array_append(acc["out"], F.struct(at.alias("start"), end.alias("stop"))).alias("out"),
                    F.greatest(end - overlap, end - size // 4).alias("at"),
                    (end >= n).alias("done"),
                )
            )

        chunks = F.aggregate(F.sequence(F.lit(1), F.greatest(turns, F.lit(1))), first, step, lambda acc: acc["out"])
        single = F.array(F.struct(F.lit(0).alias("start"), n.alias("stop")))
        return F.when(n <= size, single).otherwise(chunks)

    rows = docs.select(key, t.alias("_t"), F.posexplode(let(t, cut)).alias("chunk_no", "c"))
    return rows.select(key, "chunk_no", "c.start", "c.stop", F.substring("_t", F.col("c.start") + 1, F.col("c.stop") - F.col("c.start")).alias("text"))


# ---- chunkers with a small Arrow helper ----------------------------------------------------------------------------


def _semantic_groups(texts: list[str], vectors: list[np.ndarray], target: int, limit: int, threshold: float) -> list[str]:
    groups: list[list[str]] = []
    size, mean = 0, None
    for text, vec in zip(texts, vectors):
        grown = size + 2 + len(text)
        drift = groups and grown > target and float(mean @ vec) < threshold
        if not groups or grown > limit or drift:
            groups.append([text])
            size, mean = len(text), vec
        else:
            groups[-1].append(text)
            size, mean = grown, (mean + vec) / 2
    return ["\n\n".join(g).strip() for g in groups]


def _grouped(texts: pa.Array, vectors: pa.Array, target: int, limit: int, threshold: float) -> pa.Array:
    """The groups of every document of a batch. The batch stays in Arrow: Python holds the texts and vectors of one document at a time."""
    out = [pa.array([], pa.list_(pa.string()))]
    for p, v in zip(texts, vectors, strict=True):
        groups = _semantic_groups(p.as_py(), [x.values.to_numpy(zero_copy_only=False) for x in v], target, limit, threshold)
        out.append(pa.array([groups], pa.list_(pa.string())))
    return pa.concat_arrays(out)


def semantic_chunks(
    docs: DataFrame, min_chars: int = 160, target: int = 2600, limit: int = 3400, threshold: float = 0.78, overlap: int = 1, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Paragraphs merged until ``limit`` characters, or ``target`` when the topic drifts from the running mean
    vector. Paragraphs and vectors are made in the JVM; docs may bring ``vectors`` for its paragraphs."""
    t = strip(F.coalesce(F.col(text), F.lit("")))
    raw = F.filter(F.transform(F.split(t, "\n\n", -1), strip), lambda p: p != "")
    long = F.filter(raw, lambda p: F.length(p) >= min_chars)
    paras = F.when(F.size(long) > 0, long).when(t != "", F.array(t)).otherwise(_strings())

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def group(ps: pa.Array, vs: pa.Array) -> pa.Array:
        return _grouped(ps, vs, target, limit, threshold)

    rows = docs.select(key, paras.alias("_p"), *(["vectors"] if "vectors" in docs.columns else []))
    vectors = F.col("vectors") if "vectors" in docs.columns else F.transform("_p", lambda p: hash_vector(p))
    out = _exploded(rows.withColumn("_v", vectors), group("_p", "_v"), key)
    return stitch_overlap(out, overlap, key) if overlap > 0 else out


def _recursive(text: str, separators: list[str], size: int, overlap: int) -> list[str]:
    """Split at the first separator that occurs, recurse into long pieces, merge short ones with overlap."""
    sep = next((s for s in separators if s == "" or s in text), separators[-1])
    rest = separators[separators.index(sep) + 1 :]
    pieces = [p for p in (re.split(f"(?={re.escape(sep)})", text) if sep else list(text)) if p]
    out: list[str] = []
    cur: list[str] = []
    for piece in [*pieces, None]:
        if piece is None or len(piece) >= size or sum(map(len, cur)) + len(piece) > size:
            if cur and (merged := "".join(cur).strip()):
                out.append(merged)
            if piece is None:
                break
            if len(piece) >= size:
                out.extend(_recursive(piece, rest, size, overlap) if rest else [piece])
                cur = []
                continue
            while cur and (sum(map(len, cur)) > overlap or sum(map(len, cur)) + len(piece) > size):
                cur.pop(0)
        cur.append(piece)
    return out


def recursive_chunks(docs: DataFrame, size: int = 2000, overlap: int = 200, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", ""), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that fits."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(ts: pd.Series) -> pd.Series:
        return pd.Series([_recursive(t, list(separators), size, overlap) for t in ts])

    return _exploded(docs, split(F.coalesce(F.col(text), F.lit(""))), key)


def stitch_overlap(chunks: DataFrame, k: int = 1, key: str = "doc_id") -> DataFrame:
    """Each chunk starts with the last ``k`` paragraphs of the one before it in its document."""
    paras = F.filter(F.transform(F.split("text", "\n\n", -1), strip), lambda p: p != "")
    tail = let(paras, lambda p: F.array_join(F.slice(p, F.greatest(F.size(p) - (k - 1), F.lit(1)), F.lit(k)), "\n\n"))
    w = Window.partitionBy(key).orderBy("chunk_no")
    rows = chunks.withColumn("_tail", F.lag(tail).over(w))
    text = F.when(F.coalesce("_tail", F.lit("")) != "", strip(F.concat("_tail", F.lit("\n\n"), F.col("text")))).otherwise(F.col("text"))
    return rows.withColumn("text", text).drop("_tail")


# ---- strategies -------------------------------------------------------------------------------------------------------


def fallback_chunks(docs: DataFrame, max_total: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Page, section and sliding chunks of a document in this order, equal ones once; ``max_total`` keeps the first ones."""

    def both(t: Column) -> Column:
        every = F.concat(_page_merged(t, 120, 4000), _section_packed(t, 2600, 900, 200), _sliding(t, 2400, 700, None, 200))
        return first_of(F.array_distinct(F.filter(F.transform(every, strip), lambda c: F.length(c) >= 200)), max_total)

    return _exploded(docs, let(strip(F.coalesce(F.col(text), F.lit(""))), both), key)


def build_chunks(docs: DataFrame, strategy: str = "semantic", top: int | None = None, key: str = "doc_id") -> DataFrame:
    """Chunks by one strategy, ranked by priority words; all of them, or the best ``top`` of each document."""
    makers = {
        "semantic": lambda: semantic_chunks(docs, key=key),
        "custom": lambda: custom_chunks(docs, key=key),
        "sections": lambda: section_pack_chunks(docs, 2600, 900, key=key),
        "sliding": lambda: sliding_chunks(docs, 2400, 700, key=key),
        "pages": lambda: page_merge_chunks(docs, 120, key=key),
    }
    chunks = makers.get(strategy.lower().strip(), lambda: fallback_chunks(docs, key=key))()
    return rank_chunks(chunks.select(F.col(key).alias("doc_id"), "chunk_no", "text"), top)


def preprocessed_chunks(docs: DataFrame, strategy: str = "semantic") -> DataFrame:
    """Cleaned documents to ranked chunks."""
    return build_chunks(docs.withColumn("text", expanded(without_back_matter(cleaned(F.col("text"))))), strategy)


# ---- ids, metadata, context ----------------------------------------------------------------------------------------------


def chunk_id_of(doc: Column, kind: Column, identifier: Column) -> Column:
    return F.substring(F.md5(F.encode(F.concat_ws("_", doc.cast("string"), kind, identifier.cast("string")), "UTF-8")), 1, 16)


def keywords_of(c: Column, n: int = 20) -> Column:
    """The most frequent words of four or more letters; ties by first use."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]{4,})"), F.lit(1))
    kept = F.filter(found, lambda w: ~w.isin(fv.CHUNK_KEYWORD_STOP_WORDS))
    best = F.transform(counted_in_place(kept), lambda x: F.struct((-x["tf"]).alias("n"), x["at"].alias("p"), x["term"].alias("w")))
    return F.transform(F.slice(F.sort_array(best), 1, n), lambda x: x["w"])


def chunk_metadata(chunks: DataFrame, keywords: int = 10) -> DataFrame:
    """Adds chunk_id, word_count, char_count, keywords and content_type to (doc_id, chunk_type, page_num, chunk_no, text)."""
    ident = F.concat_ws("_", F.col("page_num").cast("string"), F.col("chunk_no").cast("string"))
    return chunks.withColumns(
        {
            "chunk_id": chunk_id_of(F.col("doc_id"), F.col("chunk_type"), ident),
            "word_count": word_count(F.col("text")),
            "char_count": F.length("text"),
            "keywords": keywords_of(F.col("text"), keywords),
            "content_type": content_type_of(F.col("text")),
        }
    )


def element_context(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``context``: the lines around the line that holds an equation's text or a caption; figures also get
    the lines around mentions of their number. Without a hit, the page.

    The first lines of the text and of the caption are looked for whole.
    elements: doc_id, page_num, element_type, number, text, caption, latex; pages: doc_id, page_num, text.
    """
    p = pages.select("doc_id", "page_num", F.col("text").alias("_page"))
    kind = F.col("element_type")

    def around(ls: Column, i: Column, before: int | Column, after: int | Column) -> Column:
        lo = F.greatest(i - before, F.lit(0))
        return F.array_join(F.slice(ls, lo + 1, i + after + 1 - lo), " ")

    def first_hit(ls: Column, test) -> Column:
        return F.array_position(F.transform(ls, test), F.lit(True)).cast("int") - 1

    def context(ls: Column) -> Column:
        latex = F.coalesce("latex", F.lit(""))
        eq = first_hit(ls, lambda l: (latex != "") & (F.contains(l, F.split("text", "\n", 2)[0]) | F.contains(l, latex)))
        caption = F.split(F.coalesce("caption", F.lit("")), "\n", 2)[0]
        cap = first_hit(ls, lambda l: F.contains(l, caption) & ((caption != "") | (kind == "table")))
        n = F.col("number").cast("string")
        refs = [F.concat(F.lit(x), n) for x in ("Figure ", "Fig. ", "Fig ", "figure ")]

        def mention(l: Column) -> Column:
            return F.contains(l, refs[0]) | F.contains(l, refs[1]) | F.contains(l, refs[2]) | F.contains(l, refs[3])

        spots = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: (i != cap) & mention(F.get(ls, i)))
        own = F.when(cap >= 0, F.array(around(ls, cap, 5, 5))).otherwise(_strings())
        figure = F.array_distinct(F.concat(own, F.transform(spots, lambda i: around(ls, i, 2, 2))))
        return (
            F.when((kind == "equation") & (eq >= 0), around(ls, eq, fv.CONTEXT_WINDOW["equation"], fv.CONTEXT_WINDOW["equation"]))
            .when((kind == "table") & (cap >= 0), around(ls, cap, fv.CONTEXT_WINDOW["table"], fv.CONTEXT_WINDOW["table"]))
            .when((kind == "figure") & (F.size(figure) > 0), F.array_join(figure, " "))
        )

    rows = elements.join(p, ["doc_id", "page_num"], "left")
    return rows.withColumn("context", F.coalesce(let(lines(F.coalesce("_page", F.lit(""))), context), F.col("_page"))).drop("_page")


def build_all_chunks(text_chunks: DataFrame, elements: DataFrame, pages: DataFrame, min_chars: int = 100) -> DataFrame:
    """One chunk table of elements (with context and priority) and text chunks of ``min_chars`` or more.

    text_chunks: doc_id, page_num, chunk_no, text, section.
    """
    e = element_context(elements, pages)
    priority = F.coalesce(*[F.when(F.col("chunk_type") == k, F.lit(v)) for k, v in fv.CONTENT_PRIORITY.items()])
    items = e.withColumn("chunk_type", F.col("element_type")).withColumn(
        "chunk_id", chunk_id_of(F.col("doc_id"), F.col("element_type"), F.col("number"))
    )
    items = items.withColumn("variables", F.when(F.col("element_type") == "equation", variables_of(F.col("text"))))
    items = items.select("chunk_id", "doc_id", "page_num", "chunk_type", "number", "text", "caption", "section", "context", "variables")
    texts = text_chunks.where(F.length(strip(F.col("text"))) >= min_chars).withColumn("chunk_type", F.lit("text"))
    texts = chunk_metadata(texts).select(
        "chunk_id", "doc_id", "page_num", "chunk_type", strip(F.col("text")).alias("text"), "section", "keywords", "content_type", "word_count", "char_count"
    )
    return items.unionByName(texts, allowMissingColumns=True).withColumn("content_priority", priority)


CANONICAL = ["abstract", "introduction", "methodology", "results", "conclusion", "limitations", "future_work"]


def canonical_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, abstract, introduction, methodology, results, conclusion, limitations, future_work) of markdown documents.

    Several headings add to one section; without headings the whole text is the introduction.
    """
    heading = r"(?m)^#{1,4}\s+(.+)$"
    t = F.coalesce(F.col(text), F.lit(""))

    def name(h: Column) -> Column:
        low = F.lower(strip(h))
        return F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in fv.CANONICAL_SECTIONS.items()])

    heads = F.transform(F.regexp_extract_all(t, F.lit(heading), F.lit(1)), name)
    bodies = F.split(t, heading, -1)
    parts = F.zip_with(
        heads,
        F.slice(bodies, F.lit(2), F.greatest(F.size(bodies) - 1, F.lit(0))),
        lambda h, b: F.struct(h.alias("section"), strip(b).alias("body")),
    )
    rows = docs.select(key, t.alias("_t"), F.filter(parts, lambda p: p["section"].isNotNull() & (p["body"] != "")).alias("_p"), F.size(heads).alias("_n"))

    def section(s: str) -> Column:
        joined = strip(F.array_join(F.transform(F.filter("_p", lambda p: p["section"] == s), lambda p: p["body"]), "\n\n"))
        return F.when(F.col("_n") == 0, F.col("_t")).otherwise(joined).alias(s) if s == "introduction" else joined.alias(s)

    return rows.select(key, *[section(s) for s in CANONICAL])
