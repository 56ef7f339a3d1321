"""Registered queries for papers, histories, set operations, counts and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from litmill.functions import fixed_values as fv
from litmill.functions.skew import numbered, spread, top_k
from litmill.operators import history, metrics, papers
from litmill.operators.chunking import keywords_of
from litmill.plans import derived as dv
from litmill.plans.activity_sql import ORACLES  # noqa: F401
from litmill.plans.tables import table
from litmill.streaming import jobs

# ---- papers ------------------------------------------------------------------------------------


def _sources(spark, d):
    """Parts as two paper sources: titles of the second differ in punctuation and repeat."""
    p = table(spark, d, "part")
    base = p.select(
        F.col("p_partkey").alias("paper_id"), F.col("p_partkey").alias("pos"), F.concat("p_name", F.lit(" "), F.col("p_size").cast("string")).alias("title"),
        F.array("p_brand").alias("authors"), F.floor("p_retailprice").cast("bigint").alias("citations"), F.array("p_type").alias("topic_tags"), F.col("p_brand").alias("venue"), "p_size",
    )
    left = base.where("p_size <= 30").drop("p_size").withColumn("citations", F.lit(0).cast("bigint"))
    right = base.where("p_size >= 20").withColumn("title", F.concat(F.upper("title"), F.lit("!")))
    right = right.withColumn("topic_tags", F.when(F.col("p_size") % 2 == 0, F.array().cast("array<string>")).otherwise(F.col("topic_tags"))).drop("p_size")
    return left, right


def merge_papers(spark, d):
    m = papers.merge_papers(*_sources(spark, d))
    return m.withColumn("authors", F.array_join("authors", ",")).withColumn("topic_tags", F.array_join("topic_tags", ","))


def search_accounting(spark, d):
    left, right = _sources(spark, d)
    return papers.search_accounting(left, right, papers.merge_papers(left, right))


def fuzzy_duplicates(spark, d):
    """Parts and customers as citations: titles differ in a letter or a digit."""
    c = table(spark, d, "customer")
    p = table(spark, d, "part")
    a = c.select(
        F.col("c_custkey").alias("paper_id"), F.when(F.col("c_acctbal") < 0, F.concat(F.lit("10.1/"), F.col("c_nationkey").cast("string"))).alias("doi"),
        F.concat(F.lower("c_mktsegment"), F.lit(" study number "), F.col("c_custkey").cast("string")).alias("title"),
        F.array(F.concat(F.lit("A. "), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.lit("")))).alias("authors"), F.col("c_nationkey").cast("string").alias("year"),
    )
    b = p.select(
        (F.col("p_partkey") + 1_000_000).alias("paper_id"), F.lit(None).cast("string").alias("doi"), F.concat("p_name", F.lit(" made by "), "p_brand").alias("title"),
        F.array().cast("array<string>").alias("authors"), F.lit("2000").alias("year"),
    )
    return papers.fuzzy_duplicates(a.unionByName(b))


def paper_distributions(spark, d):
    return papers.paper_distributions(dv.papers(spark, d))


def top_keywords(spark, d):
    return papers.top_keywords(dv.papers(spark, d), 8)


def author_impact(spark, d):
    return papers.author_impact(dv.papers(spark, d))


def top_cited(spark, d):
    return papers.top_cited(dv.papers(spark, d), 10)


def paper_trend(spark, d):
    return papers.paper_trend(dv.papers(spark, d), "2000-06-30")


def inferred_tags(spark, d):
    t = papers.inferred_tags(table(spark, d, "documents").select("doc_id", "text"), "text")
    return t.select("doc_id", F.array_join("inferred_tags", " ").alias("tags"))


def _scored(spark, d):
    """Every document as a paper, scored for its question."""
    docs = table(spark, d, "documents").select("doc_id", F.split("text", "\n", -1)[0].alias("title"), F.col("text").alias("abstract"), "lang", "source", "n_chars")
    q = dv.questions(spark, d).select("doc_id", "query")
    rows = q.join(docs, "doc_id")
    tags = F.array("lang", F.element_at(F.split("title", " "), 1))
    return rows.select("doc_id", "n_chars", papers.semantic_score(F.col("query"), F.col("title"), F.col("abstract")).alias("semantic"), papers.topic_score(F.col("query"), tags).alias("topic"))


def semantic_score(spark, d):
    return _scored(spark, d).select("doc_id", "semantic")


def topic_score(spark, d):
    return _scored(spark, d).select("doc_id", "topic")


def hybrid_score(spark, d):
    s = _scored(spark, d).select("doc_id", "semantic", "topic", F.col("n_chars").alias("citations"), F.when(F.col("doc_id") % 2 == 0, F.floor(F.col("doc_id") / 2)).alias("source_rank"))
    ranked = s.agg(F.count("source_rank").alias("n")).select("n").scalar()
    return papers.hybrid_score(s, ranked).select("doc_id", F.round("hybrid", 4).alias("hybrid"))


def page_of(spark, d):
    r = numbered(dv.papers(spark, d).withColumn("neg", -F.col("citations")), [], ["neg", "paper_id"], F.floor(F.col("neg") / 5000), "rank")
    return papers.page_of(r, 3, 20).select("paper_id", "rank", "has_more")


# ---- joins, sets ----------------------------------------------------------------------------------


def dedup_equations(spark, d):
    e = dv.elements(spark, d).where("element_type = 'equation'")
    return history.dedup_equations(e.select("doc_id", F.col("chunk_id").alias("eq_id"), F.col("text").alias("latex"), ((F.col("line_no") % 10) / 10.0).alias("confidence")))


def _refs(spark, d):
    """Line items refer to element numbers of the document of their order."""
    li = table(spark, d, "lineitem")
    n = table(spark, d, "documents").agg(F.count("*").alias("n")).select("n").scalar()
    return li.select((F.col("l_orderkey") % n).alias("doc_id"), F.when(F.col("l_returnflag") == "A", "equation").when(F.col("l_returnflag") == "N", "table").otherwise("figure").alias("element_type"),
                     F.col("l_quantity").cast("bigint").alias("number")).distinct()


def _registry(spark, d):
    return dv.elements(spark, d).where("number <> 2").select("doc_id", "element_type", "number", "chunk_id")


def nearest_element(spark, d):
    return history.nearest_element(_refs(spark, d), _registry(spark, d))


def lookup_element(spark, d):
    own = history.lookup_element(_refs(spark, d), _registry(spark, d)).withColumn("how", F.lit("own"))
    anyd = history.lookup_element(_refs(spark, d), _registry(spark, d), True).withColumn("how", F.lit("any"))
    return own.unionByName(anyd)


def _workspace(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_name").alias("name"))
    o = table(spark, d, "orders")
    files = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("uploaded_at"), (F.col("o_orderstatus") == "P").alias("is_deleted"))
    li = table(spark, d, "lineitem").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    sessions = li.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.col("o_custkey").alias("owner"), F.when(F.col("l_returnflag") != "R", F.col("l_shipdate")).alias("last_message_at")).distinct()
    searches = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("owner"), "ts")
    return c, files, sessions, searches


def workspace_tables(spark, d):
    return history.workspace_tables(*_workspace(spark, d))


def cascade_delete(spark, d):
    users, files, _, _ = _workspace(spark, d)
    return history.cascade_delete(files, users.where("owner % 2 = 0")).select("id", "owner")


def workspace_summary(spark, d):
    s = history.workspace_summary(*_workspace(spark, d)[1:])
    text = lambda c: F.coalesce(F.array_join(F.col(c).cast("array<string>"), ","), F.lit("")).alias(c)
    return s.select("owner", "file_count", "session_count", *[text(c) for c in ("recent_files", "recent_sessions", "recent_searches")])


def first_distinct(spark, d):
    return history.first_distinct(table(spark, d, "documents").select("doc_id", "lang", "text"), ["lang", "text"], ["doc_id"]).select("doc_id", "lang")


def novel_evidence(spark, d):
    l = dv.doc_lines(spark, d).where("line <> ''")
    ev = l.where("line_no % 3 <> 0").select(F.col("doc_id").alias("paper_id"), F.col("line").alias("text"))
    pairs = table(spark, d, "documents").select(F.col("doc_id").alias("pair_id"), F.col("doc_id").alias("paper_a"), (F.col("doc_id") + 1).alias("paper_b"))
    raw = l.select(F.col("doc_id").alias("pair_id"), F.col("line").alias("text"))
    return history.novel_evidence(pairs, ev, raw)


def add_missing(spark, d):
    l = dv.doc_lines(spark, d).select("doc_id", "line_no", "line")
    return history.add_missing(l.where("line_no % 2 = 0"), l.withColumn("line", F.concat(F.lit(" "), "line")), ["doc_id"], "line", ["line_no"])


# ---- history -----------------------------------------------------------------------------------------


def recent_context(spark, d):
    return history.recent_context(dv.turns(spark, d))


def _hour():
    return F.date_trunc("hour", F.col("ts"))


def history_segments(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return history.history_segments(e, "user_id", ["ts", "event_id"], "event_type", F.date_trunc("day", "ts")).select("event_id", "segment")


def number_rows(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "ts")
    return history.number_rows(e, ["event_type"], ["ts", "event_id"], _hour()).select("event_id", "event_type", "number")


def keyset_page(spark, d):
    return history.keyset_page(table(spark, d, "events").select("event_id", "ts", "event_type"), "ts", "2024-01-20 00:00:00", 50, F.col("event_type") == "view")


def _orders(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("updated_at"), F.col("o_totalprice").alias("price"), F.lit(False).alias("is_deleted"))


def upsert_documents(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice")
    n = li.count()
    o = spread(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], n)
    li = spread(li, ["l_orderkey"], n).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    ch = li.groupBy(F.col("l_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("l_shipdate").alias("updated_at")).agg(F.max("l_extendedprice").alias("price"))
    return history.upsert_documents(_orders(spark, d), ch.withColumn("is_deleted", F.lit(False))).select("id", "owner", "updated_at", "price")


def apply_deletes(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_quantity > 45")
    action = F.when(F.col("l_returnflag") == "R", "hard").when(F.col("l_returnflag") == "A", "soft").when(F.col("l_linestatus") == "F", "none").otherwise(F.when(F.col("l_tax") == 0, "clear").otherwise("none"))
    deletes = li.select(action.alias("action"), F.col("l_orderkey").alias("id"), F.col("o_custkey").alias("owner"))
    return history.apply_deletes(_orders(spark, d), deletes).select("id", "owner", "is_deleted")


def _requests(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("request_id"), F.col("event_type").alias("key"), "ts", F.floor(F.col("value") * 100).cast("bigint").alias("tokens"))


_LIMITS = {"requests_minute": 2, "tokens_minute": 6000, "tokens_day": 250_000, "tokens_month": 6_000_000}


def quota_usage(spark, d):
    return history.quota_usage(_requests(spark, d), _LIMITS).select("request_id", "requests_minute", "tokens_minute", "tokens_day", "tokens_month", "status")


def top_k_documents(spark, d):
    return top_k(table(spark, d, "documents").select("lang", "doc_id", "n_chars"), ["lang"], [F.col("n_chars").desc(), F.col("doc_id")], 5)


def session_titles(spark, d):
    return history.session_titles(table(spark, d, "conversations"))


def transcript(spark, d):
    return history.transcript(table(spark, d, "conversations"))


def _blocks(spark, d):
    l = dv.doc_lines(spark, d)
    text = F.when(F.col("line_no") % 5 == 0, F.concat(F.lit("Fig. 3 "), F.col("line"))).when(F.col("line_no") % 5 == 1, F.concat(F.lit("2 Section "), "source")).when(
        F.col("line_no") % 5 == 2, F.concat(F.lit("y"), F.col("line_no").cast("string"), F.lit(" = α"))
    ).otherwise(F.col("line"))
    return l.select("doc_id", F.floor(F.col("line_no") / 10).cast("int").alias("page_num"), F.col("line_no").alias("block_no"), text.alias("text"))


def number_elements(spark, d):
    return history.number_elements(_blocks(spark, d))


# ---- counts, evaluation --------------------------------------------------------------------------------


def chunk_counts(spark, d):
    return history.chunk_counts(dv.chunks(spark, d), ["text", "equation", "table", "figure"])


def chunk_keywords(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(keywords_of(F.col("text"), 20), " ").alias("keywords"))


def chat_stats(spark, d):
    return history.chat_stats(dv.turns(spark, d)).withColumn("avg_retrieval_score", F.round("avg_retrieval_score", 6))


def _extractions(spark, d):
    l = dv.doc_lines(spark, d)
    out = l.select(F.col("doc_id").alias("paper_id"), F.col("line_no").alias("chunk_idx"),
                   F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("This paper "), "line")).otherwise(F.col("line")).alias("abstract"),
                   F.when(F.col("line_no") % 2 == 0, F.lit("not found")).otherwise(F.col("line")).alias("results"))
    return out


def merge_sections(spark, d):
    return history.merge_sections(_extractions(spark, d), ["abstract", "results"])


def merge_key_figures(spark, d):
    l = dv.doc_lines(spark, d)
    sec = F.element_at(F.array(*map(F.lit, ["Results", "abstract", "conclusion", "other"])), F.col("line_no") % 4 + 1)
    f = l.select(F.col("doc_id").alias("paper_id"), F.col("line_no").alias("pos"), F.concat(F.lit(" N "), (F.length("line") % 3).cast("string")).alias("label"),
                 (F.length("line") % 2).cast("string").alias("value"), F.col("line").alias("context"), sec.alias("section"))
    return history.merge_key_figures(f)


def _whole_cases(spark, d):
    """The whole text as the answer; expected are the first words of all its lines, the context their last words."""
    docs = table(spark, d, "documents")
    words = F.transform(F.split("text", "\n", -1), lambda x: F.split(x, " ", -1))
    cases = docs.select(F.col("doc_id").alias("case_id"), F.col("lang").alias("category"), F.transform(words, lambda w: F.element_at(w, 1)).alias("expected"), F.transform(words, lambda w: F.element_at(w, -1)).alias("context"),
                        F.when(F.col("n_chars") % 2 == 0, F.element_at(F.element_at(words, -1), 1)).alias("exact_match"), (F.col("doc_id") % 5 == 0).alias("is_negative_control"))
    answers = docs.select(F.col("doc_id").alias("case_id"), F.when(F.col("doc_id") % 10 == 0, F.lit(fv.NOT_CONTAINED)).otherwise(F.col("text")).alias("answer"), F.array("source", "lang").alias("sources"))
    return answers, cases


def evaluate_whole_answers(spark, d):
    e = history.evaluate_answers(*_whole_cases(spark, d))
    return e.select("case_id", "category", F.round("hit_rate", 6).alias("hit_rate"), F.round("faithfulness", 6).alias("faithfulness"), "exact_match", "passed")


def whole_answers_summary(spark, d):
    s = history.evaluation_summary(history.evaluate_answers(*_whole_cases(spark, d)))
    return s.select("category", "cases", *[F.round(c, 6).alias(c) for c in ("hit_rate", "faithfulness", "exact_match")], "passed")


def answer_quality(spark, d):
    a = history.answer_quality(dv.turns(spark, d).select("conv_id", "turn", F.col("user_query").alias("query"), F.col("assistant_response").alias("response")))
    return a.select("conv_id", "turn", *[F.round(c, 6).alias(c) for c in ("completeness", "relevance", "clarity", "conciseness", "overall")])


def quiz_scores(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("attempt_id"), F.col("l_partkey").alias("item_id"), F.concat(F.lit(" brand#"), (F.col("l_quantity") % 25).cast("int").cast("string")).alias("answer"))
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("answer"))
    return history.quiz_scores(li, items).withColumn("score", F.round("score", 6))


def element_catalogue(spark, d):
    return history.element_catalogue(dv.elements(spark, d))


# ---- metrics ------------------------------------------------------------------------------------------





def _is_error():
    return F.col("event_type") == "error"


def _events(spark, d):
    return table(spark, d, "events").select("ts", "event_type", "user_id", "value")


def bucket_quantile(spark, d):
    q = metrics.bucket_quantile(_events(spark, d), ["event_type"])
    return q.select("event_type", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


def request_rates(spark, d):
    r = metrics.request_rates(_events(spark, d), _is_error())
    return r.select("window_start", F.round("requests_per_s", 6).alias("requests_per_s"), F.round("errors_per_s", 6).alias("errors_per_s"))


def request_rates_stream(spark, d):
    """The same over a stream of the table: windows the watermark has passed."""
    r = metrics.request_rates(jobs.table_stream(spark, d, "events").select("ts", "event_type"), _is_error())
    r = r.select("window_start", F.round("requests_per_s", 6).alias("requests_per_s"), F.round("errors_per_s", 6).alias("errors_per_s"))
    return jobs.run_available(r, "rates").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def error_rates(spark, d):
    r = metrics.error_rates(_events(spark, d), ["user_id"], _is_error())
    return r.select("window_start", "user_id", "increase", F.round("errors_per_s", 6).alias("errors_per_s"))


def latency_quantiles(spark, d):
    r = metrics.latency_quantiles(_events(spark, d), ["event_type"])
    return r.select("window_start", "event_type", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


def _stream(spark, d):
    return jobs.table_stream(spark, d, "events").select("ts", "event_type", "user_id", "value")


def _plain_start(df):
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def error_rates_stream(spark, d):
    r = metrics.error_rates(_stream(spark, d), ["user_id"], _is_error())
    r = r.select("window_start", "user_id", "increase", F.round("errors_per_s", 6).alias("errors_per_s"))
    return _plain_start(jobs.run_available(r, "errors"))


def latency_quantiles_stream(spark, d):
    r = metrics.latency_quantiles(_stream(spark, d), ["event_type"])
    r = r.select("window_start", "event_type", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))
    return _plain_start(jobs.run_available(r, "latency"))


def metric_totals_stream(spark, d):
    """Totals since the beginning, as the stream's state stands at the end."""
    return jobs.run_complete(metrics.metric_totals(_stream(spark, d), ["event_type"]), "totals")


def silence_stream(spark, d):
    r = jobs.run_available(jobs.silence_stream(_stream(spark, d), "event_type", 10), "silence")
    return r.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("absent_from", "absent_to")})


_RULES = [("HighErrorRate", "error_share", 0.1, 2), ("HighLatency", "p95", 20.0, 3), ("RateLimitHit", "limit_hits", 0.0, 0)]


def _measures(events):
    rows = events.withColumn("service", F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")))
    return metrics.five_minute_measures(rows, "service", _is_error(), F.col("event_type") == "signup", F.col("value") > 100)


def alerts(spark, d):
    return metrics.alerts(_measures(_events(spark, d)), _RULES).withColumn("value", F.round("value", 6))


def alerts_stream(spark, d):
    """Measures as one stream into a table, alerts as a second stateful stream over that table."""
    measures = _measures(jobs.table_stream(spark, d, "events").select("ts", "event_type", "user_id", "value"))
    folder = jobs.write_available(measures, "measures")
    a = jobs.run_available(jobs.alerts_stream(jobs.folder_stream(spark, folder), _RULES), "alerts")
    when = {c: F.col(c).cast("timestamp_ntz") for c in ("minute", "since")}
    return a.withColumns({**when, "value": F.round("value", 6)})


def absence_alerts(spark, d):
    return metrics.absence_alerts(_events(spark, d), "event_type", 10)


def active_requests(spark, d):
    e = _events(spark, d).withColumn("value", F.col("value") * 60)
    return metrics.active_requests(e, "event_type")


def quota_stream(spark, d):
    r = jobs.table_stream(spark, d, "events").select(F.col("event_id").alias("request_id"), F.col("event_type").alias("key"), "ts", F.floor(F.col("value") * 100).cast("bigint").alias("tokens"))
    return jobs.run_available(jobs.quota_stream(r, _LIMITS), "quota")


def dedup_stream(spark, d):
    docs = jobs.table_stream(spark, d, "documents").select("doc_id", "text", F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"))
    return jobs.run_available(jobs.dedup_stream(docs).select("content_hash"), "dedup")


def metric_totals(spark, d):
    return metrics.metric_totals(_events(spark, d), ["event_type"])


QUERIES = {
    "joi1_merge_papers": merge_papers, "joi2_fuzzy_duplicates": fuzzy_duplicates, "joi3_dedup_equations": dedup_equations,
    "joi4_nearest_element": nearest_element, "joi5_lookup_element": lookup_element, "joi7_workspace_tables": workspace_tables,
    "joi7_cascade_delete": cascade_delete, "set2_first_distinct": first_distinct, "set3_novel_evidence": novel_evidence,
    "set4_add_missing": add_missing, "agg1_paper_distributions": paper_distributions, "agg2_top_keywords": top_keywords,
    "agg3_author_impact": author_impact, "agg4_top_cited": top_cited, "agg5_paper_trend": paper_trend,
    "agg6_search_accounting": search_accounting, "agg7_chunk_counts": chunk_counts, "agg8_chunk_keywords": chunk_keywords,
    "agg9_inferred_tags": inferred_tags, "agg10_chat_stats": chat_stats, "agg11_workspace_summary": workspace_summary,
    "agg12_merge_sections": merge_sections, "agg13_merge_key_figures": merge_key_figures,
    "agg14_evaluate_whole_answers": evaluate_whole_answers, "agg14_whole_answers_summary": whole_answers_summary,
    "agg15_answer_quality": answer_quality, "agg16_quiz_scores": quiz_scores,
    "agg17_bucket_quantile": bucket_quantile, "agg18_element_catalogue": element_catalogue, "sco1_semantic_score": semantic_score,
    "sco2_topic_score": topic_score, "sco3_hybrid_score": hybrid_score, "sco4_page_of": page_of, "win1_recent_context": recent_context,
    "win2_history_segments": history_segments, "win3_number_rows": number_rows, "win4_keyset_page": keyset_page,
    "win5_upsert_documents": upsert_documents, "win6_apply_deletes": apply_deletes, "win7_quota_usage": quota_usage,
    "win8_top_k": top_k_documents, "win9_session_titles": session_titles, "win10_transcript": transcript,
    "win11_number_elements": number_elements, "str1_request_rates": request_rates, "str1_request_rates_stream": request_rates_stream,
    "str2_error_rates": error_rates, "str3_latency_quantiles": latency_quantiles, "str4_alerts": alerts, "str4_alerts_stream": alerts_stream,
    "str2_error_rates_stream": error_rates_stream, "str3_latency_quantiles_stream": latency_quantiles_stream,
    "str9_metric_totals_stream": metric_totals_stream, "str5_silence_stream": silence_stream,
    "str5_absence_alerts": absence_alerts, "str6_active_requests": active_requests, "str7_quota_stream": quota_stream,
    "str8_dedup_stream": dedup_stream, "str9_metric_totals": metric_totals,
}
