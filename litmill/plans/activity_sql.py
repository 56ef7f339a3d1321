"""SQL for the queries of ``activity``."""

from __future__ import annotations

from litmill.functions import fixed_values as fv
from litmill.plans import derived as dv

_TK = "trim(regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_SRC = f"""l as (select p_partkey as paper_id, p_name || ' ' || p_size as title, p_brand as authors, 0::bigint as citations, p_type as topic_tags, p_brand as venue, {_TK.format(x="p_name || ' ' || p_size")} as k from part where p_size <= 30),
  r as (select p_partkey as paper_id, upper(p_name || ' ' || p_size) || '!' as title, p_brand as authors, floor(p_retailprice)::bigint as citations, case when p_size % 2 = 0 then '' else p_type end as topic_tags, p_brand as venue,
    {_TK.format(x="p_name || ' ' || p_size || '!'")} as k from part where p_size >= 20),
  rl as (select * from r qualify row_number() over (partition by k order by paper_id desc) = 1),
  rf as (select * from r where k not in (select k from l) qualify row_number() over (partition by k order by paper_id) = 1),
  merged as (select l.paper_id, l.title, coalesce(rl.authors, l.authors) as authors, coalesce(rl.citations, l.citations) as citations, coalesce(nullif(rl.topic_tags, ''), l.topic_tags) as topic_tags,
      coalesce(rl.venue, l.venue) as venue, case when rl.k is null then 'arxiv' else 'arxiv,openalex' end as source from l left join rl using (k)
    union all select paper_id, title, authors, citations, topic_tags, venue, 'openalex' from rf)"""
_CIT = """c as (select c_custkey as paper_id, case when c_acctbal < 0 then '10.1/' || c_nationkey end as doi, lower(c_mktsegment) || ' study number ' || c_custkey as title,
    case when c_custkey % 3 = 0 then c_name else '' end as surname, c_nationkey::varchar as year from customer
  union all select p_partkey + 1000000, null, p_name || ' made by ' || p_brand, '', '2000' from part),
  t as (select *, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') as k from c)"""
_STOPP = ", ".join(f"'{w}'" for w in fv.PAPER_STOP_WORDS)


def _ptok(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: w not in ({_STOPP}) and length(w) > 2))"


_SCO = f"""{dv.SQL_QUESTIONS},
  b as (select doc_id, n_chars, {_ptok('query')} as q, {_ptok('string_split(text, chr(10))[1]')} as t, {_ptok('text')} as a,
    list_distinct(regexp_extract_all(lower(lang || ' ' || string_split(string_split(text, chr(10))[1], ' ')[1]), '[a-z0-9]+')) as tags from questions join documents using (doc_id)),
  n as (select *, len(list_intersect(q, t)) as nt, (len(list_intersect(q, t)) * 3 + len(list_intersect(q, a)))::double / greatest(len(q) * 4, 1) as raw from b),
  sc as (select doc_id, n_chars, case when len(q) = 0 then 0.5 else round(least(1.0, case when nt > 0 then least(1.0, raw + 0.15::double) else raw end), 4) end::double as semantic,
    case when len(q) = 0 then 0.5 else round(least(1.0, len(list_intersect(q, tags))::double / greatest(len(q), 1)), 4) end::double as topic from n)"""
_REFS = f"""{dv.SQL_ELEMENTS}, reg as (select doc_id, element_type, number, chunk_id from elements where number <> 2),
  refs as (select distinct l_orderkey % (select count(*) from documents) as doc_id, case l_returnflag when 'A' then 'equation' when 'N' then 'table' else 'figure' end as element_type, l_quantity::bigint as number from lineitem)"""
_WS = """files as (select o_orderkey as id, o_custkey as owner, o_orderdate as tm, o_orderstatus = 'P' as del from orders),
  sessions as (select distinct l_orderkey * 100 + l_linenumber as id, o_custkey as owner, case when l_returnflag <> 'R' then l_shipdate end as tm from lineitem join orders on l_orderkey = o_orderkey),
  searches as (select event_id as id, user_id as owner, ts as tm from events)"""


def _bq(counts: str, q: float, buckets=tuple(fv.REQUEST_BUCKETS)) -> str:
    b = "[" + ", ".join(f"{float(x)}::double" for x in buckets) + "]"
    n = len(buckets)
    return f"""(select case when c[{n + 1}] = 0 then null when i >= {n} then {b}[{n}] else lo + ({b}[i + 1] - lo) * ((rk - bel) / (c[i + 1] - bel)) end from (
      select c, rk, i, case when i > 0 then {b}[i] else 0.0::double end as lo, case when i > 0 then c[i] else 0 end as bel from (
        select {counts} as c, {counts}[{n + 1}] * {q}::double as rk, len(list_filter({counts}, lambda x: x < {counts}[{n + 1}] * {q}::double)) as i)))"""


_COUNTS = "[" + ", ".join(f"count(*) filter (value <= {b})" for b in fv.REQUEST_BUCKETS) + ", count(value)]"
# Sliding windows of five minutes: an event lies in the five that end after it.
_SLIDE = """s as (select e.*, 's' || (user_id % 3) as service, time_bucket(interval 1 minute, ts) - to_minutes(i) as window_start from events e, range(5) t(i))"""
_ALERT = f"""{_SLIDE}, m as (select service as label, window_start + interval 5 minutes as minute, count(*) filter (event_type = 'error') / count(*)::double as error_share,
    count(*) filter (event_type = 'signup')::double as limit_hits, {_COUNTS} as cnt from s group by all),
  p as (select *, {_bq('cnt', 0.95)} as p95 from m),
  br as (select 'HighErrorRate' as rule, label, minute, error_share as value, 2 as hold from p where error_share > 0.1 union all select 'HighLatency', label, minute, p95, 3 from p where p95 > 20
    union all select 'RateLimitHit', label, minute, limit_hits, 0 from p where limit_hits > 0),
  g as (select *, epoch(minute)::bigint // 60 - row_number() over (partition by rule, label order by minute) as g from br),
  al as (select *, min(minute) over (partition by rule, label, g) as since from g)"""
_QUOTA = """u as (select event_id as request_id, floor(value * 100)::bigint as tokens,
    count(*) over (w range between interval 60 seconds preceding and current row exclude group) as requests_minute,
    coalesce(sum(floor(value * 100)::bigint) over (w range between interval 60 seconds preceding and current row exclude group), 0)::bigint as tokens_minute,
    coalesce(sum(floor(value * 100)::bigint) over (w range between interval 86400 seconds preceding and current row exclude group), 0)::bigint as tokens_day,
    coalesce(sum(floor(value * 100)::bigint) over (w range between interval 2592000 seconds preceding and current row exclude group), 0)::bigint as tokens_month
  from events window w as (partition by event_type order by ts))"""
_WHOLE_CASES = f"""q as (select doc_id as case_id, lang as category, list_transform(w, lambda x: x[1]) as expected, list_transform(w, lambda x: x[-1]) as context, case when n_chars % 2 = 0 then w[-1][1] end as em, doc_id % 5 = 0 as neg,
      case when doc_id % 10 = 0 then '{fv.NOT_CONTAINED}' else text end as answer, source || ' ' || lang as src
    from (select *, list_transform(string_split(text, chr(10)), lambda x: string_split(x, ' ')) as w from documents)),
  ev as (select case_id, category, len(list_filter(context, lambda x: contains(lower(answer) || ' ' || lower(src), lower(x)))) / len(context)::double as hit0, len(context) as nc,
      case when neg then (case when {' or '.join(f"contains(lower(answer), '{p}')" for p in fv.REFUSALS)} then 1.0 else 0.0 end)
        when {' or '.join(f"contains(lower(answer), '{p}')" for p in fv.DENIALS)} then 0.0 else len(list_filter(expected, lambda x: contains(lower(answer), lower(x)))) / len(expected)::double end::double as faithfulness,
      case when em is null then null when contains(answer, em) then 1.0 else 0.0 end::double as exact_match from q),
  e2 as (select *, case when nc = 0 then 1.0 else hit0 end::double as hit_rate from ev)"""

ORACLES = {
    "joi1_merge_papers": f"with {_SRC} select * from merged",
    "agg6_search_accounting": f"""with {_SRC} select 'retrieved' as measure, (select count(*) from l) + (select count(*) from r) as n
      union all select x, (select count(*) from merged) from (values ('deduplicated'), ('filtered'), ('ranked')) v(x)
      union all select 'source:' || s, count(*) from (select unnest(string_split(source, ',')) as s from merged) group by 1""",
    "joi2_fuzzy_duplicates": f"""with {_CIT},
      f as (select k, min(paper_id) as f from t group by 1),
      near as (select a.k, min(b.f) as f from f a join f b on abs(length(a.k) - length(b.k)) <= greatest(length(a.k), length(b.k)) / 10 and 1 - levenshtein(a.k, b.k)::double / greatest(length(a.k), length(b.k)) >= 0.9 group by 1)
      select paper_id, m as duplicate_of, 'doi' as reason from (select paper_id, min(paper_id) over (partition by doi) as m from t where doi is not null) where m < paper_id
      union all select paper_id, f, 'title' from t join near using (k) where f < paper_id
      union all select paper_id, m, 'author_year' from (select paper_id, min(paper_id) over (partition by surname, year) as m from t where surname <> '') where m < paper_id""",
    "joi4_nearest_element": f"""with {_REFS}, j as (select f.*, r.number as cand from refs f left join reg r using (doc_id, element_type))
      select doc_id, element_type, number, arg_min(cand, (abs(cand - number), cand)) as nearest from j group by doc_id, element_type, number""",
    "joi5_lookup_element": f"""with {_REFS} select doc_id, element_type, number, chunk_id, 'own' as how from refs join reg using (doc_id, element_type, number)
      union all select doc_id, element_type, number, chunk_id, 'any' from refs join (select element_type, number, min(chunk_id) as chunk_id from reg group by all) using (element_type, number)""",
    "joi7_workspace_tables": f"""with {_WS} select c_custkey as owner, c_name as name, coalesce(a.n, 0) as n_files, coalesce(b.n, 0) as n_sessions, coalesce(d.n, 0) as n_searches from customer
      left join (select owner, count(*) as n from files where not del group by 1) a on a.owner = c_custkey left join (select owner, count(*) as n from sessions group by 1) b on b.owner = c_custkey
      left join (select owner, count(*) as n from searches group by 1) d on d.owner = c_custkey""",
    "joi7_cascade_delete": f"with {_WS} select id, owner from files where owner not in (select c_custkey from customer where c_custkey % 2 = 0)",
    "agg11_workspace_summary": f"""with {_WS}, o as (select owner from files where not del union select owner from sessions union select owner from searches),
      nf as (select owner, string_agg(id, ',' order by rn) as l from (select *, row_number() over (partition by owner order by tm desc nulls last, id desc) as rn from files where not del) where rn <= 5 group by 1),
      ns as (select owner, string_agg(id, ',' order by rn) as l from (select *, row_number() over (partition by owner order by tm desc nulls last, id desc) as rn from sessions) where rn <= 5 group by 1),
      nq as (select owner, string_agg(id, ',' order by rn) as l from (select *, row_number() over (partition by owner order by tm desc nulls last, id desc) as rn from searches) where rn <= 10 group by 1)
      select o.owner, (select count(*) from files f where f.owner = o.owner and not del) as file_count, (select count(*) from sessions s where s.owner = o.owner) as session_count,
        coalesce(nf.l, '') as recent_files, coalesce(ns.l, '') as recent_sessions, coalesce(nq.l, '') as recent_searches from o left join nf using (owner) left join ns using (owner) left join nq using (owner)""",
    "set2_first_distinct": "select min(doc_id) as doc_id, lang from documents group by lang, text",
    "set3_novel_evidence": f"""with {dv.SQL_LINES}, ev as (select doc_id, line from lines where line <> '' and line_no % 3 <> 0)
      select distinct doc_id as pair_id, line as text from lines l where line <> '' and not exists (select 1 from ev where ev.doc_id in (l.doc_id, l.doc_id + 1) and ev.line = l.line)""",
    "set4_add_missing": f"""with {dv.SQL_LINES}, b as (select doc_id, line_no::int as line_no, line from lines where line_no % 2 = 0)
      select *, false as added from b union all
      select doc_id, line_no::int, ' ' || line, true from (select * from lines l where not exists (select 1 from b where b.doc_id = l.doc_id and {dv.sql_strip('b.line')} = {dv.sql_strip('l.line')})
        qualify row_number() over (partition by doc_id, {dv.sql_strip('line')} order by line_no) = 1)""",
    "agg1_paper_distributions": f"""with {dv.SQL_PAPERS} select 'year' as kind, substring(published_date, 1, 4) as value, count(*) as n from papers group by 2
      union all select 'source', trim(s), count(*) from (select unnest(string_split(source, ',')) as s from papers) group by 2""",
    "agg2_top_keywords": f"with {dv.SQL_PAPERS} select k as keyword, count(*) as n from (select unnest(topic_tags) as k from papers) group by 1 order by n desc, k limit 8",
    "agg3_author_impact": f"""with {dv.SQL_PAPERS}, b as (select authors[1] as author, count(*) as paper_count, sum(citations)::bigint as citations from papers group by 1)
      select *, round(paper_count * 0.5::double + ln(1 + citations) * 0.5::double, 2) as impact_score from b order by impact_score desc, author limit 7""",
    "agg4_top_cited": f"with {dv.SQL_PAPERS} select paper_id, title, citations, substring(published_date, 1, 4) as year, source from papers order by citations desc, paper_id limit 10",
    "agg5_paper_trend": f"""with {dv.SQL_PAPERS}, t as (select count(*) as total_papers, round(sum(citations)::double / count(*), 1) as avg_citations, max(citations) as max_citations,
        count(*) filter (published_date >= '2000-05-31') as papers_last_30_days, count(*) filter (published_date[1:4]::int between 1998 and 2000) as recent, count(*) filter (published_date[1:4]::int < 1998) as older from papers)
      select *, case when recent > older * 0.6 then '{fv.TREND_RISING}' when recent < older * 0.3 then '{fv.TREND_DECLINING}' else '{fv.TREND_STABLE}' end as trend from t""",
    "sco1_semantic_score": f"with {_SCO} select doc_id, semantic from sc",
    "sco2_topic_score": f"with {_SCO} select doc_id, topic from sc",
    "sco3_hybrid_score": f"""with {_SCO} select doc_id, round(semantic * 0.4::double + topic * 0.2::double + (case when doc_id % 2 = 0 then greatest(0.0, 1.0 - (doc_id // 2) / (select count(*) from sc where doc_id % 2 = 0)::double) else 0.0 end)::double * 0.25::double
      + least(1.0, ln(1 + n_chars) / 10.0::double)::double * 0.15::double, 4) as hybrid from sc""",
    "sco4_page_of": f"with {dv.SQL_PAPERS}, r as (select paper_id, row_number() over (order by citations desc, paper_id) as rank from papers) select paper_id, rank, 60 < (select count(*) from r) as has_more from r where rank between 41 and 60",
    "win1_recent_context": f"""with {dv.SQL_TURNS}, r as (select *, row_number() over (partition by conv_id order by turn desc) as rn from turns where response_valid)
      select conv_id, turn, 'user' as role, user_query as content from r where rn <= 3 union all select conv_id, turn, 'assistant', assistant_response from r where rn <= 3""",
    "win2_history_segments": """with l as (select *, lag(event_type) over (partition by user_id order by ts, event_id) as b from events)
      select event_id, sum(case when b <> event_type then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as segment from l""",
    "win3_number_rows": "select event_id, event_type, row_number() over (partition by event_type order by ts, event_id) as number from events",
    "win4_keyset_page": "select event_id, ts, event_type from events where event_type = 'view' and ts < timestamp '2024-01-20' order by ts desc limit 50",
    "win5_upsert_documents": """with a as (select o_orderkey as id, o_custkey as owner, o_orderdate as updated_at, o_totalprice as price, 0 as n from orders
        union all select l_orderkey, o_custkey, l_shipdate, max(l_extendedprice), 1 from lineitem join orders on l_orderkey = o_orderkey group by 1, 2, 3)
      select id, owner, updated_at, price from a qualify row_number() over (partition by id, owner order by updated_at desc, n desc) = 1""",
    "win6_apply_deletes": """with x as (select l_orderkey as id, o_custkey as owner, case when l_returnflag = 'R' then 'hard' when l_returnflag = 'A' then 'soft' when l_linestatus = 'F' then 'none' when l_tax = 0 then 'clear' else 'none' end as a
        from lineitem join orders on l_orderkey = o_orderkey where l_quantity > 45)
      select o_orderkey as id, o_custkey as owner, exists (select 1 from x where a = 'soft' and x.id = o_orderkey and x.owner = o_custkey) as is_deleted from orders
      where not exists (select 1 from x where a = 'hard' and x.id = o_orderkey and x.owner = o_custkey) and o_custkey not in (select owner from x where a = 'clear')""",
    "win7_quota_usage": f"""with {_QUOTA} select request_id, requests_minute, tokens_minute, tokens_day, tokens_month,
      case when (225000 - tokens_day <= 0 and tokens > 225000 - tokens_day) or (5400000 - tokens_month <= 0 and tokens > 5400000 - tokens_month) then 'blocked'
        when requests_minute >= 2 or tokens_minute + tokens > 6000 then 'wait' else 'allowed' end as status from u""",
    "win8_top_k": "select lang, doc_id, n_chars, rank from (select lang, doc_id, n_chars, row_number() over (partition by lang order by n_chars desc, doc_id)::int as rank from documents) where rank <= 5",
    "win9_session_titles": """with m as (select conv_id, arg_min(text, turn) filter (role = 'user') as f, max(turn) as last_turn from conversations group by 1)
      select conv_id, case when length(f) > 50 then substring(f, 1, 50) || '...' else f end as title, last_turn from m""",
    "win10_transcript": "select conv_id, turn, case when role = 'user' then 'user' else 'ai' end as role, text as content from conversations where role <> 'system'",
    "agg7_chunk_counts": f"with {dv.SQL_CHUNKS} select doc_id, count(*) as total, " + ", ".join(f"count(*) filter (chunk_type = '{k}') as n_{k}" for k in ("text", "equation", "table", "figure")) + " from chunks group by 1",
    "agg8_chunk_keywords": """with k as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{4,}')) as w, generate_subscripts(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{4,}'), 1) as i from documents),
      g as (select doc_id, w, count(*) as n, min(i) as i from k group by all), r as (select *, row_number() over (partition by doc_id order by n desc, i) as rn from g),
      a as (select doc_id, string_agg(w, ' ' order by rn) as l from r where rn <= 20 group by 1)
      select doc_id, coalesce(l, '') as keywords from documents left join a using (doc_id)""",
    "agg10_chat_stats": f"""with {dv.SQL_TURNS} select conv_id, count(*) as total_turns, count(*) filter (response_valid) as valid_turns, count(*) filter (not response_valid) as failed_turns,
      round(avg(retrieval_score), 6) as avg_retrieval_score, max(turn) as latest_turn from turns group by 1""",
    "agg12_merge_sections": f"""with {dv.SQL_LINES}, x as (select doc_id, line_no, unnest(['abstract', 'results']) as f, unnest([case when line_no % 3 = 0 then 'This paper ' || line else line end, case when line_no % 2 = 0 then 'not found' else line end]) as v from lines),
      s as (select *, length(v) * 0.5 + (length(v) - length(regexp_replace(v, '[0-9]', '', 'g'))) * 8 + (length(v) - length(replace(v, '%', ''))) * 15 - case when {' or '.join(f"starts_with(lower({dv.sql_strip('v')}), '{g}')" for g in fv.GENERIC_OPENERS)} then 20 else 0 end as sc
        from x where lower({dv.sql_strip('v')}) not in ('', 'not found')),
      b as (select doc_id, f, arg_min(v, (-sc, line_no)) as v from s group by all)
      select doc_id as paper_id, coalesce((select v from b where b.doc_id = d.doc_id and f = 'abstract'), 'Not found') as abstract, coalesce((select v from b where b.doc_id = d.doc_id and f = 'results'), 'Not found') as results from documents d""",
    "agg13_merge_key_figures": f"""with {dv.SQL_LINES}, f as (select doc_id as paper_id, line_no, ' N ' || (length(line) % 3) as label, (length(line) % 2)::varchar as value, line as context, ['Results', 'abstract', 'conclusion', 'other'][line_no % 4 + 1] as section,
        [0, 1, 2, 99][line_no % 4 + 1] as p from lines)
      select paper_id, label, value, context, section from f qualify row_number() over (partition by paper_id, label, value order by p, line_no) = 1""",
    "agg14_evaluate_whole_answers": f"with {_WHOLE_CASES} select case_id, category, round(hit_rate, 6) as hit_rate, round(faithfulness, 6) as faithfulness, exact_match, hit_rate >= 0.5 and faithfulness >= 0.5 as passed from e2",
    "agg14_whole_answers_summary": f"""with {_WHOLE_CASES} select category, count(*) as cases, round(avg(hit_rate), 6) as hit_rate, round(avg(faithfulness), 6) as faithfulness, round(avg(exact_match), 6) as exact_match,
      count(*) filter (hit_rate >= 0.5 and faithfulness >= 0.5) as passed from e2 group by 1""",
    "agg15_answer_quality": f"""with {dv.SQL_TURNS}, w as (select conv_id, turn, assistant_response as r, list_distinct({dv.sql_words('lower(user_query)')}) as q, {dv.sql_words('assistant_response')} as rw from turns),
      s as (select conv_id, turn, case when length({dv.sql_strip('r')}) > 100 then least(1.0, length(r) / 500.0::double) else 0.0 end::double as c, least(1.0, len(list_intersect(q, list_distinct(list_transform(rw, lambda x: lower(x)))))::double / greatest(len(q), 1))::double as v,
        1.0::double / (1 + len(rw)::double / greatest(len(string_split_regex(r, '[.!?]+')), 1) / 20) as y, case when length(r) > 1000 then greatest(0.5, 1.0 - (length(r) - 1000) / 2000.0::double) else 1.0 end::double as z from w)
      select conv_id, turn, round(c, 6) as completeness, round(v, 6) as relevance, round(y, 6) as clarity, round(z, 6) as conciseness, round((c + v + y + z) / 4, 6) as overall from s""",
    "agg16_quiz_scores": """select l_orderkey as attempt_id, count(*) as answered, count(*) filter ('brand#' || (l_quantity % 25)::int = lower(p_brand)) as correct,
      round(count(*) filter ('brand#' || (l_quantity % 25)::int = lower(p_brand))::double / count(*), 6) as score from lineitem join part on l_partkey = p_partkey group by 1""",
    "agg17_bucket_quantile": f"with h as (select event_type, count(*) as n, {_COUNTS} as cnt from events group by 1) select event_type, n, round({_bq('cnt', 0.5)}, 6) as p50, round({_bq('cnt', 0.95)}, 6) as p95 from h",
    "agg18_element_catalogue": f"""with {dv.SQL_ELEMENTS}, n as (select *, upper(element_type[1]) || element_type[2:] || ' ' || number as nm from elements),
      l as (select *, '- ' || nm || ' (Page ' || page_num || ')' || case when element_type <> 'equation' and trim(caption) <> '' and lower(trim(caption)) <> lower(nm) then ': ' || trim(caption) else '' end as line from n)
      select doc_id, element_type, 'Found ' || count(*) || ' ' || element_type || 's in the document.' || chr(10) || chr(10) || string_agg(line, chr(10) order by number, page_num) as catalogue from l group by 1, 2""",
    "str1_request_rates": "select time_bucket(interval 1 minute, ts) as window_start, round(count(*) / 60.0::double, 6) as requests_per_s, round(count(*) filter (event_type = 'error') / 60.0::double, 6) as errors_per_s from events group by 1",
    "str1_request_rates_stream": """select time_bucket(interval 1 minute, ts) as window_start, round(count(*) / 60.0::double, 6) as requests_per_s, round(count(*) filter (event_type = 'error') / 60.0::double, 6) as errors_per_s from events
      group by 1 having window_start + interval 1 minute <= (select max(ts) from events) - interval 10 minutes""",
    "str2_error_rates": f"with {_SLIDE} select window_start, user_id, count(*) as increase, round(count(*) / 300.0::double, 6) as errors_per_s from s where event_type = 'error' group by all",
    "str3_latency_quantiles": f"with {_SLIDE}, h as (select window_start, event_type, count(*) as n, {_COUNTS} as cnt from s group by all) select window_start, event_type, n, round({_bq('cnt', 0.5)}, 6) as p50, round({_bq('cnt', 0.95)}, 6) as p95 from h",
    "str2_error_rates_stream": f"""with {_SLIDE} select window_start, user_id, count(*) as increase, round(count(*) / 300.0::double, 6) as errors_per_s from s where event_type = 'error'
      and window_start + interval 5 minutes <= (select max(ts) from events where event_type = 'error') - interval 10 minutes group by all""",
    "str3_latency_quantiles_stream": f"""with {_SLIDE}, h as (select window_start, event_type, count(*) as n, {_COUNTS} as cnt from s
        where window_start + interval 5 minutes <= (select max(ts) from events) - interval 10 minutes group by all)
      select window_start, event_type, n, round({_bq('cnt', 0.5)}, 6) as p50, round({_bq('cnt', 0.95)}, 6) as p95 from h""",
    "str9_metric_totals_stream": "select event_type, count(*) as total, max(ts) as last_ts from events group by 1",
    "str5_silence_stream": """with t as (select max(ts) - interval 10 minutes as mark from events),
      m as (select distinct event_type as label, date_trunc('minute', ts) as m from events), d as (select m.* from m, t where m + interval 1 minute <= mark),
      n as (select *, lead(m) over (partition by label order by m) as nx from d), g as (select *, (epoch(nx)::bigint - epoch(m)::bigint) // 60 - 1 as gap from n)
      select label, 'back' as what, m + interval 1 minute as absent_from, nx as absent_to, gap as minutes from g where gap > 10
      union all select label, 'silent', m + interval 1 minute, null, 11 from g, t where gap > 10 or nx is null and m + interval 12 minutes < mark""",
    "str4_alerts": f"with {_ALERT} select rule, label, minute, round(value, 6) as value, since from al where epoch(minute) - epoch(since) >= hold * 60",
    "str4_alerts_stream": f"""with {_ALERT} select rule, label, minute, round(value, 6) as value, since from al
      where epoch(minute) - epoch(since) >= hold * 60 and minute <= (select max(ts) from events) - interval 10 minutes""",
    "str5_absence_alerts": """with m as (select distinct event_type as label, date_trunc('minute', ts) as m from events), n as (select *, coalesce(lead(m) over (partition by label order by m), (select max(m) from m)) as nx from m)
      select label, m + interval 1 minute as absent_from, nx as absent_to, (epoch(nx)::bigint - epoch(m)::bigint) // 60 - 1 as minutes from n where (epoch(nx)::bigint - epoch(m)::bigint) // 60 - 1 > 10""",
    "str6_active_requests": """with m as (select event_type, epoch_us(ts) as us, 1 as d from events union all select event_type, epoch_us(ts) + round(value * 60 * 1000000)::bigint, -1 from events),
      g as (select event_type, us, sum(d) as c from m group by all)
      select event_type, make_timestamp(us) as "at", sum(c) over (partition by event_type order by us rows unbounded preceding)::bigint as active from g""",
    "str8_dedup_stream": "select distinct md5(text) as content_hash from documents",
    "str9_metric_totals": "select event_type, count(*) as total, max(ts) as last_ts from events group by 1",
}
