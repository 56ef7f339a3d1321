"""Registered queries for sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from litmill.plans import derived as dv
from litmill.plans.tables import table
from litmill.session import ensure_checkpoint_dir
from litmill.sources import corpus, model_output, sinks


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_corpus(spark, d):
    return corpus.read_corpus(spark, f"{d}/documents.parquet").select("doc_id", "text")


def html_text_stats(spark, d):
    return corpus.html_text_stats(table(spark, d, "pages")).select("page_id", "body_text", "word_count", "char_count")


def turns_json(spark, d):
    path = _folder(spark, "turns")
    t = dv.turns(spark, d).withColumnRenamed("turn", "turn_id")
    sinks.write_turns(t.withColumn("response_citations", F.array(F.lit("Page 1"), F.col("document_id"))), path)
    return sinks.read_turns(spark, path).select(
        "conv_id", "turn_id", "user_query", "assistant_response", "retrieval_score", "response_valid",
        F.array_join("response_citations", "|").alias("citations"),
    )


def vectors_reload(spark, d):
    path = _folder(spark, "vectors")
    sinks.save_vectors(table(spark, d, "embeddings"), path)
    v = sinks.load_vectors(spark, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return v.select("vec_id", "label", F.size("embedding").alias("dims"), F.round(total, 6).alias("total"))


def _registry(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return docs.groupBy(corpus.content_hash(F.col("text")).alias("content_hash")).agg(
        F.max("source").alias("session_id"),
        F.max("doc_id").cast("string").alias("filename"),
        F.max(F.col("quality") == 1).alias("analysis_complete"),
    )


def new_documents(spark, d):
    return corpus.new_documents(table(spark, d, "documents"), _registry(spark, d)).select("doc_id", "content_hash")


def registry_apply(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    action = (
        F.when(F.col("lang") == "fr", "register")
        .when(F.col("lang") == "de", "complete")
        .when(F.col("toxic") == 1, "drop_hash")
        .when(F.col("lang") == "es", "drop_session")
        .otherwise("complete")
    )
    changes = docs.select(
        F.col("doc_id").alias("seq"),
        action.alias("action"),
        corpus.content_hash(F.col("text")).alias("content_hash"),
        F.concat("source", F.lit("-"), F.floor(F.col("n_chars") / 500).cast("string")).alias("session_id"),
        F.col("doc_id").cast("string").alias("filename"),
        F.lit(False).alias("analysis_complete"),
    )
    reg = _registry(spark, d).withColumn("session_id", F.concat("session_id", F.lit("-1")))
    return corpus.registry_apply(reg, changes)


def _triple_answers(spark, d):
    s = table(spark, d, "supplier").join(
        table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    body = F.concat(
        F.lit('{"entities": [{"id": "'), F.col("s_name"), F.lit('", "type": "Organisation"}, {"id": "'), F.col("n_name"),
        F.lit('", "type": ""}], "relations": [{"source": "'), F.col("s_name"), F.lit('", "target": "'), F.col("n_name"),
        F.lit('", "predicate": "located in", "evidence": "'), F.col("s_acctbal").cast("string"), F.lit('"}]}'),
    )
    raw = (
        F.when(F.col("s_acctbal") < 1000, F.substring(body, 1, 60))
        .when(F.col("s_acctbal") < 5000, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone.")))
        .otherwise(F.concat(F.lit("Answer: "), body, F.lit(" end")))
    )
    return s.select(F.col("s_suppkey").alias("chunk_id"), raw.alias("raw"))


def parse_triples(spark, d):
    return model_output.parse_triples(_triple_answers(spark, d))


def _array_answers(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    raw = F.concat(
        F.lit('```\n[{"head": "'), F.col("s_name"), F.lit('", "relation": " part of ", "tail": "'), F.col("n_name"),
        F.lit('", "tail_type": "Country"}, {"head": "", "tail": "x"}, {"name": "'), F.col("n_name"), F.lit('"}]'),
        F.when(F.col("s_acctbal") < 0, "").otherwise("\n```"),
    )
    return s.select(F.col("s_suppkey").alias("chunk_id"), raw.alias("raw"))


def parse_entities(spark, d):
    return model_output.parse_entities(_array_answers(spark, d))


def parse_relations(spark, d):
    return model_output.parse_relations(_array_answers(spark, d))


def valid_quiz_items(spark, d):
    p = table(spark, d, "part")
    options = F.when(F.col("p_size") < 10, F.concat(F.lit('["'), "p_brand", F.lit('"]'))).otherwise(
        F.concat(F.lit('["'), "p_brand", F.lit('", "'), "p_type", F.lit('"]'))
    )
    answer = F.when(F.col("p_retailprice") < 1000, F.concat(F.lit(', "answer": "'), "p_brand", F.lit('"'))).otherwise("")
    raw = F.concat(
        F.lit('Here: [{"question": "'), F.col("p_name"), F.lit('", "options": '), options, answer, F.lit("}] thanks")
    )
    items = model_output.valid_quiz_items(p.select(F.col("p_partkey").alias("response_id"), raw.alias("raw")))
    return items.select("response_id", "pos", "question", F.array_join("options", "|").alias("options"), "answer")


def repair_json(spark, d):
    o = table(spark, d, "orders")
    whole = F.concat(
        F.lit('{"rows": [{"k": '), F.col("o_orderkey").cast("string"), F.lit('}, {"p": "'), F.col("o_orderpriority"), F.lit(" }]\"}]}")
    )
    raw = (
        F.when(F.col("o_orderstatus") == "F", whole)
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit('[{"k": '), F.col("o_orderkey").cast("string"), F.lit('}, {"p": "5-')))
        .otherwise(F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
    )
    return model_output.repair_json(o.select(F.col("o_orderkey").alias("response_id"), raw.alias("raw")))


def conversation_markdown(spark, d):
    return sinks.conversation_markdown(dv.turns(spark, d).drop("document_id"))


def write_graph(spark, d):
    path = _folder(spark, "graph")
    s = table(spark, d, "supplier").select(F.col("s_name").alias("id"), F.lit("Supplier").alias("type"))
    n = table(spark, d, "nation").select(F.col("n_name").alias("id"), F.lit("Nation").alias("type"))
    e = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    sinks.write_graph(s.unionByName(n), e.select(F.col("s_name").alias("src"), F.col("n_name").alias("dst"), F.lit("LOCATED_IN").alias("type")), path)
    nodes, edges = sinks.read_graph(spark, path)
    return nodes.select(F.lit("node").alias("kind"), "type", F.col("id").alias("a"), F.lit("").alias("b")).unionByName(
        edges.select(F.lit("edge").alias("kind"), "type", F.col("src").alias("a"), F.col("dst").alias("b"))
    )


def combine_messages(spark, d):
    """All messages: each two turns of a conversation are a question's sources."""
    c = table(spark, d, "conversations")
    pair = F.concat_ws(":", F.col("conv_id").cast("string"), F.floor(F.col("turn") / 2).cast("string"))
    r = c.select(
        pair.alias("query_id"), F.col("role").alias("source"), F.col("turn").alias("pos"), "text",
        F.when(F.col("role") == "user", "").otherwise(F.concat(F.lit("https://example.org/"), "role")).alias("url"),
    )
    return sinks.combine_sources(r).withColumn("urls", F.array_join("urls", " "))


def append_history(spark, d):
    path = _folder(spark, "history")
    ev = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    hour = F.date_trunc("hour", "ts")
    for part in ("event_type = 'error'", "event_type <> 'error'"):
        sinks.append_history(ev.where(part), path, ["ts", "event_id"], hour)
    return spark.read.parquet(path).select("event_id", "id")


QUERIES = {
    "src1_read_corpus": read_corpus,
    "src2_html_text_stats": html_text_stats,
    "src3_turns_json": turns_json,
    "src4_vectors_reload": vectors_reload,
    "src5_new_documents": new_documents,
    "src6_registry_apply": registry_apply,
    "src7_parse_triples": parse_triples,
    "src8_parse_entities": parse_entities,
    "src8_parse_relations": parse_relations,
    "src9_valid_quiz_items": valid_quiz_items,
    "src10_conversation_markdown": conversation_markdown,
    "src11_write_graph": write_graph,
    "src12_combine_messages": combine_messages,
    "src13_append_history": append_history,
    "src14_repair_json": repair_json,
}

_VISIBLE = "coalesce(html, '')"
for _p in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->", r"(?s)<[^>]+>"):
    _VISIBLE = f"regexp_replace({_VISIBLE}, '{_p}', ' ', 'g')"
for _code, _ch in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
    _VISIBLE = f"replace({_VISIBLE}, '{_code}', {_ch})"

_REGISTRY = """registry as (
  select md5(text) as content_hash, max(source) as session_id, max(doc_id)::varchar as filename, bool_or(quality = 1) as analysis_complete
  from documents join labels using (doc_id) group by 1)"""

ORACLES = {
    "src1_read_corpus": f"select doc_id, text from documents where {dv.sql_strip('text')} <> ''",
    "src2_html_text_stats": f"""with v as (select page_id, {dv.sql_squeeze(_VISIBLE)} as body_text from pages)
      select page_id, body_text, len(list_filter(string_split(body_text, ' '), lambda w: w <> ''))::int as word_count,
             length(body_text)::int as char_count from v""",
    "src3_turns_json": f"""with {dv.SQL_TURNS} select conv_id, turn as turn_id, user_query, assistant_response, retrieval_score,
      response_valid, 'Page 1|' || document_id as citations from turns""",
    "src4_vectors_reload": "select vec_id, label, len(embedding)::int as dims, round(list_sum(embedding::double[]), 6) as total from embeddings",
    "src5_new_documents": f"""with {_REGISTRY} select doc_id, md5(text) as content_hash from documents
      where md5(text) not in (select content_hash from registry where analysis_complete)""",
    "src6_registry_apply": f"""with {_REGISTRY},
      changes as (
        select doc_id as seq, case when lang = 'fr' then 'register' when lang = 'de' then 'complete' when toxic = 1 then 'drop_hash'
                 when lang = 'es' then 'drop_session' else 'complete' end as action,
               md5(text) as content_hash, source || '-' || (n_chars // 500) as session_id, doc_id::varchar as filename
        from documents left join labels using (doc_id)),
      regs as (
        select -1 as seq, content_hash, session_id || '-1' as session_id, filename, analysis_complete from registry
        union all select seq, content_hash, session_id, filename, false from changes where action = 'register'),
      cur as (select * from regs qualify row_number() over (partition by content_hash order by seq desc) = 1)
      select content_hash, session_id, filename,
             analysis_complete or exists (select 1 from changes c where c.action = 'complete' and c.content_hash = cur.content_hash and c.seq > cur.seq) as analysis_complete
      from cur
      where not exists (select 1 from changes c where c.seq > cur.seq and
        ((c.action = 'drop_hash' and c.content_hash = cur.content_hash) or (c.action = 'drop_session' and c.session_id = cur.session_id)))""",
    "src7_parse_triples": """select s_suppkey as chunk_id, 0 as pos, s_name as head, 'Organisation' as head_type, 'LOCATED_IN' as relation,
      n_name as tail, 'Concept' as tail_type, s_acctbal::varchar as evidence
      from supplier join nation on s_nationkey = n_nationkey where s_acctbal >= 1000""",
    "src8_parse_entities": """select s_suppkey as chunk_id, 2 as pos, n_name as name, 'Concept' as type
      from supplier join nation on s_nationkey = n_nationkey""",
    "src8_parse_relations": """select s_suppkey as chunk_id, 0 as pos, s_name as head, 'Concept' as head_type, 'PART_OF' as relation, n_name as tail,
      'Country' as tail_type, null::varchar as evidence
      from supplier join nation on s_nationkey = n_nationkey""",
    "src9_valid_quiz_items": """select p_partkey as response_id, 0 as pos, p_name as question, p_brand || '|' || p_type as options, p_brand as answer
      from part where p_size >= 10 and p_retailprice < 1000""",
    "src10_conversation_markdown": f"""with {dv.SQL_TURNS},
      blocks as (
        select conv_id, turn, (turn // 500)::int as part_no, '## Turn ' || turn || chr(10) || '### 👤 User' || chr(10) || user_query || chr(10) || chr(10) ||
          '### 🤖 Assistant' || chr(10) || assistant_response || chr(10) || chr(10) || '📊 **Score**: ' || format('{{:.3f}}', retrieval_score) || chr(10) ||
          case when error_message <> '' then '⚠️ **Error**: ' || error_message || chr(10) else '' end || chr(10) || '---' || chr(10) || chr(10) as block
        from turns)
      select conv_id, part_no, case when part_no = 0 then '# Chat History - ' || conv_id || chr(10) || chr(10) || '---' || chr(10) || chr(10) else '' end
        || string_agg(block, '' order by turn) as markdown
      from blocks group by conv_id, part_no""",
    "src11_write_graph": """select 'node' as kind, 'Supplier' as type, s_name as a, '' as b from supplier
      union all select 'node', 'Nation', n_name, '' from nation
      union all select 'edge', 'LOCATED_IN', s_name, n_name from supplier join nation on s_nationkey = n_nationkey""",
    "src12_combine_messages": """with r as (
        select conv_id || ':' || (turn // 2) as query_id, role as source, turn as pos, text, case when role = 'user' then '' else 'https://example.org/' || role end as url from conversations)
      select query_id, string_agg('[' || source || ']' || case when url <> '' then ' — ' || url else '' end || chr(10) || text, chr(10) || chr(10) order by pos, source, text) as combined,
             coalesce(string_agg(url, ' ' order by pos, source, text) filter (url <> ''), '') as urls, count(*)::int as n_sources
      from r where trim(text) <> '' group by query_id""",
    "src13_append_history": """select event_id, row_number() over (order by event_type <> 'error', ts, event_id) as id from events""",
    "src14_repair_json": """select o_orderkey as response_id, case when o_orderstatus = 'O' then '[{"k": ' || o_orderkey || '}]'
        else '{"rows": [{"k": ' || o_orderkey || '}, {"p": "' || o_orderpriority || ' }]"}]}' end as json, true as parsed
      from orders""",
}
