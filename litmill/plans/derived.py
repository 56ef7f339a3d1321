"""Inputs that Spark derives from the given tables, each with the SQL that derives the same rows.

Document lines become pages, elements and blocks; conversations become turns; orders become papers.
Sizes follow the tables, so the queries grow with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.plans.tables import dealt, table

WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def sql_strip(x: str) -> str:
    return f"trim({x}, {WS})"


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' ')"


def sql_words(x: str) -> str:
    return f"list_filter(string_split({sql_squeeze(x)}, ' '), lambda w: w <> '')"


SQL_LINES = """lines as (
  select doc_id, lang, source, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no
  from documents)"""


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, lang, source, line_no, line) of the documents."""
    docs = dealt(table(spark, d, "documents").select("doc_id", "lang", "source", "text"))
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


HEADINGS = ["Abstract", "1 Introduction", "Methods", "Results", "References"]
SQL_HEADINGS = "['Abstract', '1 Introduction', 'Methods', 'Results', 'References']"


def paged_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose every line is a page with a marker and a section heading."""
    heads = F.array(*map(F.lit, HEADINGS))
    pages = F.transform(
        F.split("text", "\n", -1),
        lambda l, i: F.concat(
            F.lit("\n--- Page "), (i + 1).cast("string"), F.lit(" ---\n"), F.element_at(heads, i % 5 + 1), F.lit("\n"), l
        ),
    )
    return table(spark, d, "documents").select("doc_id", F.array_join(pages, "\n").alias("text"))


SQL_PAGED = f"""paged as (
  select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
    chr(10) || '--- Page ' || i || ' ---' || chr(10) || {SQL_HEADINGS}[(i - 1) % 5 + 1] || chr(10) || l), chr(10)) as text
  from documents)"""


def paragraph_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents with blank lines between their lines."""
    return table(spark, d, "documents").select("doc_id", "lang", F.regexp_replace("text", "\n", "\n\n").alias("text"))


SQL_PARAGRAPHS = "paragraphs as (select doc_id, lang, replace(text, chr(10), chr(10) || chr(10)) as text from documents)"


def elements(spark: SparkSession, d: str) -> DataFrame:
    """Numbered equations, tables and figures: every document line becomes one, in turn."""
    kinds = F.array(F.lit("equation"), F.lit("table"), F.lit("figure"))
    rows = doc_lines(spark, d).withColumn("element_type", F.element_at(kinds, (F.col("line_no") % 3 + 1)))
    number = F.floor(F.col("line_no") / 3).cast("bigint") + 1
    return rows.select(
        "doc_id",
        "element_type",
        number.alias("number"),
        (F.floor(F.col("line_no") / 5).cast("bigint") + 1).alias("page_num"),
        F.col("line").alias("text"),
        F.concat(F.initcap("element_type"), F.lit(" "), number.cast("string"), F.lit(": "), F.substring("line", 1, 60)).alias("caption"),
        F.col("source").alias("section"),
        F.concat("doc_id", F.lit("_"), "element_type", F.lit("_"), number.cast("string")).alias("chunk_id"),
        "line_no",
    )


SQL_ELEMENTS = SQL_LINES + """,
elements as (
  select doc_id, ['equation', 'table', 'figure'][line_no % 3 + 1] as element_type,
         (line_no // 3 + 1)::bigint as number, (line_no // 5 + 1)::bigint as page_num, line as text,
         ['Equation', 'Table', 'Figure'][line_no % 3 + 1] || ' ' || (line_no // 3 + 1) || ': ' || substring(line, 1, 60) as caption,
         source as section,
         doc_id || '_' || ['equation', 'table', 'figure'][line_no % 3 + 1] || '_' || (line_no // 3 + 1) as chunk_id,
         line_no
  from lines)"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Chat turns: a user message and the assistant message after it."""
    c = table(spark, d, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("user_query"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("assistant_response"))
    n = F.length("assistant_response")
    return u.join(a, ["conv_id", "turn"]).select(
        "conv_id",
        "turn",
        "user_query",
        "assistant_response",
        ((F.length("user_query") % 101) / 100.0).alias("retrieval_score"),
        (n >= 300).alias("response_valid"),
        F.when(n < 300, F.lit("too short")).otherwise("").alias("error_message"),
        F.concat(F.lit("doc"), F.floor(n / 1000).cast("string")).alias("document_id"),
    )


SQL_TURNS = """turns as (
  select u.conv_id, u.turn, u.text as user_query, a.text as assistant_response,
         (length(u.text) % 101) / 100.0::double as retrieval_score, length(a.text) >= 300 as response_valid,
         case when length(a.text) < 300 then 'too short' else '' end as error_message,
         'doc' || (length(a.text) // 1000) as document_id
  from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1
  where u.role = 'user' and a.role = 'assistant')"""


def papers(spark: SparkSession, d: str) -> DataFrame:
    """Orders as papers: the customer is the author, the price counts as citations."""
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("paper_id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" of "), F.lower("c_mktsegment"), F.lit(" goods")).alias("title"),
        F.array(F.col("c_name")).alias("authors"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_date"),
        F.floor("o_totalprice").cast("bigint").alias("citations"),
        F.when(F.col("o_orderstatus") == "F", "arxiv").when(F.col("o_orderstatus") == "O", "openalex").otherwise("arxiv, openalex").alias("source"),
        F.array(F.col("o_orderpriority"), F.col("c_mktsegment")).alias("topic_tags"),
    )


SQL_PAPERS = """papers as (
  select o_orderkey as paper_id, 'Order ' || o_orderkey || ' of ' || lower(c_mktsegment) || ' goods' as title,
         [c_name] as authors, strftime(o_orderdate, '%Y-%m-%d') as published_date,
         floor(o_totalprice)::bigint as citations,
         case o_orderstatus when 'F' then 'arxiv' when 'O' then 'openalex' else 'arxiv, openalex' end as source,
         [o_orderpriority, c_mktsegment] as topic_tags
  from orders join customer on o_custkey = c_custkey)"""


TEMPLATES = [
    ("What is ", "?"), ("Show table # about ", ""), ("Explain equation #: ", ""), ("List all figures for ", ""),
    ("Summarize the main findings of ", ""), ("", " limitations and future work"), ("Compare table 1 and 2 of ", ""), ("", ""),
]


def questions(spark: SparkSession, d: str) -> DataFrame:
    """One question per document: a whole benchmark text in one of eight forms."""
    docs = table(spark, d, "documents").select("doc_id")
    b = table(spark, d, "benchmark")
    n = b.agg(F.count("*").alias("n")).select("n").scalar()
    rows = docs.withColumn("item_id", F.col("doc_id") % n).join(b.select("item_id", F.col("text").alias("w")), "item_id")
    number = (F.col("doc_id") % 7 + 1).cast("string")
    form = F.element_at(
        F.array(*[F.concat(F.replace(F.lit(a), F.lit("#"), number), F.col("w"), F.lit(z)) for a, z in TEMPLATES]),
        (F.col("doc_id") % len(TEMPLATES) + 1).cast("int"),
    )
    return rows.select(F.col("doc_id").alias("query_id"), "doc_id", form.alias("query"))


_FORMS = ", ".join(f"replace('{a}', '#', (doc_id % 7 + 1)::varchar) || w || '{z}'" for a, z in TEMPLATES)
SQL_QUESTIONS = f"""questions as (
  select doc_id as query_id, doc_id, [{_FORMS}][doc_id % {len(TEMPLATES)} + 1] as query
  from (select doc_id, b.text as w
        from documents join benchmark b on b.item_id = doc_id % (select count(*) from benchmark)))"""


def benchmark_questions(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark text as a question, in one of eight forms, about the document of the same number."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("w"))
    number = (F.col("doc_id") % 7 + 1).cast("string")
    form = F.element_at(
        F.array(*[F.concat(F.replace(F.lit(a), F.lit("#"), number), F.col("w"), F.lit(z)) for a, z in TEMPLATES]),
        (F.col("doc_id") % len(TEMPLATES) + 1).cast("int"),
    )
    return q.select(F.col("doc_id").alias("query_id"), "doc_id", form.alias("query"))


SQL_BENCHMARK_QUESTIONS = f"""bquestions as (
  select doc_id as query_id, doc_id, [{_FORMS}][doc_id % {len(TEMPLATES)} + 1] as query
  from (select item_id as doc_id, text as w from benchmark))"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Document lines as typed chunks: every fourth line is text, the others are elements."""
    e = elements(spark, d)
    kind = F.when(F.col("line_no") % 4 == 3, "text").otherwise(F.col("element_type"))
    return e.select(
        "chunk_id", "doc_id", "page_num", kind.alias("chunk_type"), "number", "text", "caption", "section",
        F.when(kind == "equation", 1.5).when(kind == "table", 1.3).when(kind == "figure", 1.2).otherwise(1.0).alias("content_priority"),
    )


SQL_CHUNKS = SQL_ELEMENTS + """,
chunks as (
  select chunk_id, doc_id, page_num, case when line_no % 4 = 3 then 'text' else element_type end as chunk_type, number, text, caption, section,
         case when line_no % 4 = 3 then 1.0 when element_type = 'equation' then 1.5 when element_type = 'table' then 1.3 else 1.2 end::double as content_priority
  from elements)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
