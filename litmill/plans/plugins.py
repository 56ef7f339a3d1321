"""Registered queries of the plug-in points, each with a deterministic function in place of a model."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from litmill.operators import fusion, vectors
from litmill.plans import derived as dv
from litmill.plans.tables import dealt, table
from litmill.sources import model_output

DIRECTIONS = np.array([[3.0, 4.0, 0.0], [0.0, 3.0, 4.0], [4.0, 0.0, 3.0]])


def _length_model():
    """A direction by the length of the text; the operator scales it to one."""
    return lambda texts: DIRECTIONS[[len(t) % 3 for t in texts]]


def embed_with(spark, d):
    docs = dealt(table(spark, d, "documents").select("doc_id", "text"))
    e = vectors.embed_with(docs, _length_model)
    return e.select("doc_id", *[F.round(F.col("embedding")[i].cast("double"), 6).alias(f"v{i}") for i in range(3)])


def _length_scorer():
    return lambda queries, texts: [(len(t) + 7 * len(q)) % 1000 / 1000 for q, t in zip(queries, texts, strict=True)]


def rerank_with(spark, d):
    """Every document is a context of one question."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    n = q.agg(F.count("*").alias("n")).select("n").scalar()
    c = table(spark, d, "documents").select((F.col("doc_id") % n).alias("query_id"), F.col("doc_id").cast("string").alias("id"), "text")
    return fusion.rerank_with(q, c, _length_scorer, 6).select("query_id", "id", "score", "rank")


def _line_extractor():
    """The first word of each line as an entity."""
    return lambda text: json.dumps([{"name": line.split(" ")[0], "type": "Word"} for line in text.split("\n")])


def extract_with(spark, d):
    docs = dealt(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))
    return model_output.parse_entities(model_output.extract_with(docs, _line_extractor))


QUERIES = {"udf1_embed_with": embed_with, "udf2_rerank_with": rerank_with, "udf3_extract_with": extract_with}

ORACLES = {
    "udf1_embed_with": """select doc_id, [0.6, 0.0, 0.8][length(text) % 3 + 1]::double as v0, [0.8, 0.6, 0.0][length(text) % 3 + 1]::double as v1,
      [0.0, 0.8, 0.6][length(text) % 3 + 1]::double as v2 from documents""",
    "udf2_rerank_with": """with c as (select item_id as query_id, doc_id::varchar as id, ((length(d.text) + 7 * length(b.text)) % 1000) / 1000.0::double as score
        from documents d join benchmark b on b.item_id = d.doc_id % (select count(*) from benchmark)),
      r as (select *, row_number() over (partition by query_id order by score desc, id)::int as rank from c)
      select * from r where rank <= 6""",
    "udf3_extract_with": f"""with {dv.SQL_LINES} select doc_id as chunk_id, line_no::int as pos, {dv.sql_strip("string_split(line, ' ')[1]")} as name, 'Word' as type
      from lines where {dv.sql_strip("string_split(line, ' ')[1]")} <> ''""",
}
