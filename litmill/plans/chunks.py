"""Registered queries for chunkers."""

from __future__ import annotations

from pyspark.sql import functions as F

from litmill.functions import fixed_values as fv
from litmill.operators import chunking
from litmill.plans import derived as dv
from litmill.plans.tables import table


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def split_pages(spark, d):
    return chunking.split_pages(dv.paged_docs(spark, d))


def split_sections(spark, d):
    return chunking.split_sections(chunking.split_pages(dv.paged_docs(spark, d)))


def window_chunks(spark, d):
    return chunking.window_chunks(dv.paragraph_docs(spark, d).select("doc_id", "text"), 90, 25)


def custom_chunks(spark, d):
    return chunking.custom_chunks(dv.paged_docs(spark, d), 60, 15)


def semantic_chunks(spark, d):
    return chunking.semantic_chunks(dv.paragraph_docs(spark, d), 60, 900, 1400)


def stitch_overlap(spark, d):
    c = dv.doc_lines(spark, d).select("doc_id", F.col("line_no").alias("chunk_no"), F.replace("line", F.lit(". "), F.lit(".\n\n")).alias("text"))
    return chunking.stitch_overlap(c, 1)


def section_pack_chunks(spark, d):
    return chunking.section_pack_chunks(dv.paged_docs(spark, d), 1200, 200)


def sliding_chunks(spark, d):
    return chunking.sliding_chunks(_docs(spark, d))


def page_merge_chunks(spark, d):
    return chunking.page_merge_chunks(dv.paged_docs(spark, d), 150, 1500)


def boundary_chunks(spark, d):
    return chunking.boundary_chunks(_docs(spark, d), 2000, 200)


def boundary_cover(spark, d):
    """The chunks cover every text: no gap between neighbours, first at 0, last at the end."""
    c = chunking.boundary_chunks(_docs(spark, d), 2000, 200)
    ends = c.groupBy("doc_id").agg(F.min("start").alias("first"), F.max("stop").alias("last"), F.count("*").alias("n"))
    return ends.select("doc_id", "first", "last")


def layout_chunks(spark, d):
    return chunking.layout_chunks(dv.paragraph_docs(spark, d), 120, 30)


def recursive_chunks(spark, d):
    return chunking.recursive_chunks(_docs(spark, d), 800, 100)


def fallback_chunks(spark, d):
    return chunking.fallback_chunks(dv.paged_docs(spark, d))


def build_chunks(spark, d):
    out = None
    for s in ("semantic", "custom", "sections", "sliding", "pages", "fallback"):
        c = chunking.build_chunks(dv.paged_docs(spark, d), s).withColumn("strategy", F.lit(s))
        out = c if out is None else out.unionByName(c)
    return out.groupBy("strategy", "doc_id").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.sum(F.length("text")).alias("chars"))


def chunk_metadata(spark, d):
    c = dv.doc_lines(spark, d).select("doc_id", F.lit("text").alias("chunk_type"), (F.floor(F.col("line_no") / 5) + 1).alias("page_num"), F.col("line_no").alias("chunk_no"), F.col("line").alias("text"))
    m = chunking.chunk_metadata(c)
    return m.select("doc_id", "chunk_no", "chunk_id", "word_count", "char_count", "content_type", F.array_join("keywords", " ").alias("keywords"))


def _five_line_pages(spark, d):
    l = dv.doc_lines(spark, d).withColumn("page_num", F.floor(F.col("line_no") / 5).cast("bigint") + 1)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return l.groupBy("doc_id", "page_num").agg(listed.alias("text"))


def _rich_elements(spark, d):
    e = dv.elements(spark, d)
    caption = F.when(F.col("element_type") == "table", F.substring("text", 1, 30)).otherwise(F.substring("text", 5, 30))
    return e.withColumn("latex", F.substring("text", 1, 12)).withColumn("caption", caption)


def element_context(spark, d):
    return chunking.element_context(_rich_elements(spark, d), _five_line_pages(spark, d)).select("chunk_id", "context")


def build_all_chunks(spark, d):
    texts = dv.doc_lines(spark, d).select("doc_id", (F.floor(F.col("line_no") / 5).cast("bigint") + 1).alias("page_num"), F.col("line_no").alias("chunk_no"), F.col("line").alias("text"), F.col("source").alias("section"))
    c = chunking.build_all_chunks(texts, _rich_elements(spark, d), _five_line_pages(spark, d))
    return c.groupBy("doc_id", "chunk_type").agg(F.count("*").alias("n"), F.round(F.sum("content_priority"), 6).alias("priority"))


MD_HEADS = ["# Abstract", "## 1 Introduction", "### Our Method", "## Results and Discussion", "## Background", "#### Limitations", "## Thanks"]


def canonical_sections(spark, d):
    heads = F.array(*map(F.lit, MD_HEADS))
    t = F.array_join(F.transform(F.split("text", "\n", -1), lambda l, i: F.concat(F.element_at(heads, i % 7 + 1), F.lit("\n"), l)), "\n")
    plain = F.when(F.col("lang") == "de", F.col("text")).otherwise(t)
    return chunking.canonical_sections(table(spark, d, "documents").select("doc_id", plain.alias("text")))


QUERIES = {
    "chk1_split_pages": split_pages,
    "chk2_split_sections": split_sections,
    "chk3_window_chunks": window_chunks,
    "chk3_custom_chunks": custom_chunks,
    "chk4_semantic_chunks": semantic_chunks,
    "chk5_stitch_overlap": stitch_overlap,
    "chk6_section_pack_chunks": section_pack_chunks,
    "chk7_sliding_chunks": sliding_chunks,
    "chk8_page_merge_chunks": page_merge_chunks,
    "chk9_boundary_chunks": boundary_chunks,
    "chk9_boundary_cover": boundary_cover,
    "chk10_layout_chunks": layout_chunks,
    "chk11_recursive_chunks": recursive_chunks,
    "chk12_fallback_chunks": fallback_chunks,
    "chk13_build_chunks": build_chunks,
    "chk14_chunk_metadata": chunk_metadata,
    "chk15_element_context": element_context,
    "chk16_build_all_chunks": build_all_chunks,
    "chk17_canonical_sections": canonical_sections,
}

_CT = " ".join(f"when {' or '.join(f'''contains(lower(line), '{n}')''' for n in ns)} then '{k}'" for k, ns in fv.CONTENT_TYPES.items())
_SEC = {"abstract": [0], "introduction": [1, 4], "methodology": [2], "results": [3], "limitations": [5]}

ORACLES = {
    "chk1_split_pages": f"""with {dv.SQL_LINES}, p as (select doc_id, (line_no + 1)::int as page_num, {dv.sql_strip(dv.SQL_HEADINGS + "[line_no % 5 + 1] || chr(10) || line")} as text from lines) select * from p""",
    "chk2_split_sections": f"""with {dv.SQL_LINES}, p as (select doc_id, (line_no + 1)::int as page_num, 0 as section_no, {dv.SQL_HEADINGS}[line_no % 5 + 1] as title, {dv.sql_strip('line')} as body from lines)
      select doc_id, page_num, section_no, case when body = '' or title = 'Methods' then 'page' else title end as title,
        case when body = '' then title when title = 'Methods' then title || chr(10) || body else body end as text from p where body = '' or title <> 'References'""",
    "chk5_stitch_overlap": f"""with {dv.SQL_LINES}, c as (select doc_id, line_no::int as chunk_no, replace(line, '. ', '.' || chr(10) || chr(10)) as text from lines),
      t as (select *, lag(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {dv.sql_strip('p')}), lambda p: p <> '')[-1]) over (partition by doc_id order by chunk_no) as tail from c)
      select doc_id, chunk_no, case when coalesce(tail, '') <> '' then {dv.sql_strip("tail || chr(10) || chr(10) || text")} else text end as text from t""",
    "chk7_sliding_chunks": f"""with t as (select doc_id, {dv.sql_strip('text')} as t from documents), s as (select doc_id, t, unnest(range(0, length(t), 900)) as s from t),
      c as (select doc_id, s, {dv.sql_strip('substring(t, s + 1, 2800)')} as text from s),
      n as (select doc_id, (row_number() over (partition by doc_id order by s) - 1)::int as chunk_no, text from c where length(text) >= 200) select * from n""",
    "chk9_boundary_cover": "select doc_id, 0 as first, length(text)::int as last from documents",
    "chk14_chunk_metadata": f"""with {dv.SQL_LINES},
      k as (select doc_id, line_no, w, i from (select doc_id, line_no, unnest(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}_]{{4,}}')) as w, generate_subscripts(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}_]{{4,}}'), 1) as i from lines)),
      g as (select doc_id, line_no, w, count(*) as n, min(i) as i from k group by all),
      r as (select doc_id, line_no, w, row_number() over (partition by doc_id, line_no order by n desc, i) as rn from g),
      kw as (select doc_id, line_no, string_agg(w, ' ' order by rn) as keywords from r where rn <= 10 group by all)
      select doc_id, line_no::int as chunk_no, substring(md5(doc_id || '_text_' || (line_no // 5 + 1) || '_' || line_no), 1, 16) as chunk_id, len({dv.sql_words('line')})::int as word_count,
        length(line)::int as char_count, case {_CT} else 'general' end as content_type, coalesce(keywords, '') as keywords from lines left join kw using (doc_id, line_no)""",
    "chk17_canonical_sections": f"""with {dv.SQL_LINES},
      m as (select doc_id, lang, line_no, line_no % 7 as h, {dv.sql_strip('line')} as body from lines),
      s as (select doc_id, any_value(lang) as lang, """
    + ", ".join(f"coalesce(string_agg(body, chr(10) || chr(10) order by line_no) filter (h in ({', '.join(map(str, hs))}) and body <> ''), '') as {name}" for name, hs in _SEC.items())
    + f""" from m group by doc_id)
      select doc_id, case when s.lang = 'de' then '' else abstract end as abstract, case when s.lang = 'de' then d.text else {dv.sql_strip('introduction')} end as introduction,
        case when s.lang = 'de' then '' else methodology end as methodology, case when s.lang = 'de' then '' else results end as results, '' as conclusion,
        case when s.lang = 'de' then '' else limitations end as limitations, '' as future_work from s join documents d using (doc_id)""",
}
