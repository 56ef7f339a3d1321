"""SQL for queries of other modules that takes several steps: recursive chunkers, answer checks, boosted scores.

Constants are written out here, not taken from the operators.
"""

from __future__ import annotations

from litmill.plans import derived as dv
from litmill.plans.questions import ORACLES as QUESTIONS
from litmill.plans.retrieval import sql_bm25, sql_tokens
from litmill.plans.validation import ORACLES as CHECKS
from litmill.plans.validation import SQL_RESPONSES

_SEED_STOP = (
    "what which where when how why who does did the and but for are was were with that this from have has been its they their "
    "about into over more some than then each both also can could would should not any all other used use using give tell explain "
    "describe list show find get make take"
)
_REF = {
    "equation": r"\b(?:equation|eq\.)\s*#?\s*(\d+)\b",
    "table": r"\b(?:table|tbl\.)\s*#?\s*(\d+)\b",
    "figure": r"\b(?:figure|fig\.)\s*#?\s*(\d+)\b",
}
_ANY_REF = "(?i)" + "|".join(p.replace(r"(\d+)", r"\d+") for p in _REF.values())
_ASKED = f"asked as ({QUESTIONS['qry1_classify_queries']}), {SQL_RESPONSES}, r as (select response_id, doc_id, query_type, target_number, text, lower(text) as low from responses join asked using (doc_id))"


def _others(kind: str) -> str:
    hits = ", ".join(f"case when regexp_matches(low, '{p}') then '{k}' end" for k, p in _REF.items() if k != kind)
    return f"when '{kind}' then [{hits}]"


_CONFLICTS = f"list_filter(case query_type {' '.join(map(_others, _REF))} else []::varchar[] end, lambda x: x is not null)"
_INCOMPLETE = f"""list_filter([case when length({dv.sql_strip('text')}) < 50 then 'too short' end,
  case when query_type = 'specific_element' and not contains(text, coalesce(target_number::varchar, 'None')) then 'element not mentioned' end,
  case when query_type = 'list_all' and not (contains(text, '1.') or contains(text, '2.') or contains(text, '-') or contains(text, '*') or contains(text, '•')) then 'no list' end], lambda x: x is not null)"""

QUERIES: dict = {}

ORACLES = {
    "val4_type_conflicts": f"with {_ASKED} select response_id, array_to_string({_CONFLICTS}, ',') as conflicts from r",
    "val6_completeness": f"with {_ASKED} select response_id, array_to_string({_INCOMPLETE}, ',') as incomplete from r",
    "val3_correct_refs": f"""with {SQL_RESPONSES}, {dv.SQL_ELEMENTS},
      s as (select response_id, doc_id, string_split_regex(text, '{_ANY_REF}') as seps, regexp_extract_all(text, '{_ANY_REF}') as marks from responses),
      m as (select response_id, doc_id, unnest(seps) as sep, unnest(list_concat(marks, [''])) as mark, generate_subscripts(seps, 1) as i from s),
      k as (select *, case when mark = '' then null when regexp_matches(lower(mark), '^(eq)') then 'equation' when regexp_matches(lower(mark), '^t') then 'table' else 'figure' end as kind,
        regexp_extract(mark, '(\\d+)$', 1) as digits from m),
      w as (select distinct doc_id, response_id, kind as element_type, digits::bigint as number from k where kind is not null
        and not exists (select 1 from elements e where e.number <> 2 and e.doc_id = k.doc_id and e.element_type = k.kind and e.number = k.digits::bigint)),
      n as (select w.response_id, w.element_type, w.number, arg_min(e.number, (abs(e.number - w.number), e.number)) as nearest
        from w left join (select * from elements where number <> 2) e on e.doc_id = w.doc_id and e.element_type = w.element_type group by all),
      f as (select k.response_id, i, sep || case when n.number is null then mark when nearest is null then '[' || upper(kind[1]) || kind[2:] || ' NOT FOUND]'
        else upper(kind[1]) || kind[2:] || ' ' || nearest end as part from k left join n on n.response_id = k.response_id and n.element_type = k.kind and n.number = try_cast(k.digits as bigint))
      select response_id, string_agg(part, '' order by i) as text, (select count(*) from n where n.response_id = f.response_id)::int as n_wrong from f group by response_id""",
    "val8_validate": f"""with {_ASKED}, refs as (select response_id, count(*) as n from ({CHECKS['val2_invalid_refs']}) group by 1), un as ({CHECKS['val5_unsupported_numbers']}),
      p as (select *, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: lower({dv.sql_strip('x')})), lambda x: length(x) > 10) as parts from r),
      c as (select response_id, coalesce(n, 0) as a, len({_CONFLICTS}) as b, flags as c, len({_INCOMPLETE}) as d, (len(parts) > 5 and len(list_distinct(parts)) < len(parts) * 0.7)::int as e, doc_id
        from p left join refs using (response_id) join un using (response_id)),
      l as (select * from (values ('strict', 0.95::double, 0, 0.60::double), ('moderate', 0.80::double, 2, 0.45::double), ('lenient', 0.60::double, 5, 0.45::double)) l(level, need, most, least)),
      x as (select *, ((doc_id % 10) / 10.0::double < least)::int as f from c, l),
      y as (select *, case when a > 0 then 0.8 else 1 end::double * case when b > 0 then 0.7 else 1 end::double * case when c > 0 then 0.6 else 1 end::double * case when d > 0 then 0.9 else 1 end::double
        * case when e > 0 then 0.95 else 1 end::double * case when f > 0 then 0.4 else 1 end::double as conf, (a + b + c + d + e + f)::bigint as n from x)
      select response_id, round(conf, 6) as confidence, n as n_issues, round(conf, 9) >= need and n <= most and f = 0 as passed, level from y""",
    "qry3_seed_terms": f"""with {dv.SQL_QUESTIONS},
      q as (select query_id, '"' || string_split(query, ' ')[-1] || '" ' || array_to_string(list_transform(string_split(query, ' '), lambda w: case when w[1] = 'ß' then 'Ss' else upper(w[1]) end || lower(w[2:])), ' ') as q from questions),
      a as (select query_id, q, regexp_replace(q, '[^\\x00-\\x7F]', '_', 'g') as w from q),
      t as (select query_id, list_concat(regexp_extract_all(q, '"([^"]+)"', 1), regexp_extract_all(w, '\\b([A-Z][A-Za-z0-9\\-]+(?:\\s+[A-Z][A-Za-z0-9\\-]+)*)\\b', 1),
        list_filter(regexp_extract_all(w, '\\b([a-zA-Z][a-zA-Z0-9\\-]{{3,}})\\b', 1), lambda w: lower(w) not in ({', '.join(f"'{w}'" for w in _SEED_STOP.split())}))) as ts from a),
      u as (select query_id, unnest(ts) as term, generate_subscripts(ts, 1) as i from t),
      f as (select * from u qualify row_number() over (partition by query_id, lower(term) order by i) = 1)
      select query_id, (row_number() over (partition by query_id order by i) - 1)::int as pos, term from f""",
    "agg9_inferred_tags": """with w as (select doc_id, list_transform(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g'), '\\b([A-Za-z][a-z]{3,})\\b', 1), lambda x: lower(x)) as ws from documents),
      u as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from w),
      g as (select doc_id, w, row_number() over (partition by doc_id order by count(*) desc, min(i)) as rn from u
        where w not in ('that', 'with', 'this', 'from', 'have', 'been', 'they', 'which', 'their', 'also', 'such') group by doc_id, w)
      select doc_id, coalesce(string_agg(w, ' ' order by rn) filter (rn <= 5), '') as tags from documents left join g using (doc_id) group by doc_id""",
    "lex4_bm25_boosted": f"""with {dv.SQL_BENCHMARK_QUESTIONS}, {dv.SQL_CHUNKS}, {sql_bm25('unused', 'bquestions', 'chunks', 5, 'x')},
      needles as (select distinct query_id, unnest({sql_tokens('query')}) as needle from bquestions),
      inside as (select needle, term from (select distinct needle from needles), x_df where contains(term, needle)),
      sub as (select distinct query_id, chunk_id from needles join inside using (needle) join x_post using (term)),
      s as (select q.query_id, c.chunk_id, coalesce(x.score, 0) + case when sub.chunk_id is null then 0 else 0.05 end::double
          + case when contains(q.query, c.number::varchar) then 0.25 else 0 end::double + 0.15::double + c.content_priority * 0.02::double as score
        from bquestions q cross join (select * from chunks where chunk_type = 'table') c left join x_score x on x.query_id = q.query_id and x.chunk_id = c.chunk_id
        left join sub on sub.query_id = q.query_id and sub.chunk_id = c.chunk_id),
      r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id)::int as rank from s)
      select query_id, chunk_id, rank, round(score, 6) as score from r where rank <= 5""",
    "chk9_boundary_chunks": """with recursive r as (
        select doc_id, text, length(text) as n, -1 as chunk_no, 0 as start, 0 as stop, 0 as pos from documents
        union all
        select doc_id, text, n, chunk_no + 1, pos, e, greatest(e - 200, e - 500) from (
          select *, case when hard < n then coalesce(case when b > 0 then pos + 1000 + length(part) - b + 1 end, case when d > 0 then pos + 1000 + length(part) - d + 1 end, hard) else hard end as e from (
            select *, strpos(reverse(part), chr(10) || chr(10)) as b, strpos(reverse(part), ' .') as d from (
              select *, substring(text, pos + 1001, greatest(hard - pos - 1000, 0)) as part from (
                select *, case when n <= 2000 then n else least(pos + 2000, n) end as hard from r where chunk_no < 0 or stop < n)))))
      select doc_id, chunk_no, start, stop::int as stop, substring(text, start + 1, stop - start) as text from r where chunk_no >= 0""",
    "chk8_page_merge_chunks": f"""with recursive {dv.SQL_PAGED},
      l as (select doc_id, list_filter(list_transform(string_split_regex({dv.sql_strip('text')}, '\\n*--- Page \\d+ ---\\n*'), lambda p: {dv.sql_strip('p')}), lambda p: p <> '') as ps from paged),
      p as (select doc_id, unnest(ps) as page, generate_subscripts(ps, 1)::int as i from l),
      z as (select doc_id, len(ps)::int as n from l),
      s as (select doc_id, 0 as i, '' as buf, null::varchar as done from z
        union all
        select s.doc_id, s.i + 1, case when p.page is null then '' when s.buf <> '' and length(s.buf) + length(p.page) < 1500 then s.buf || chr(10) || chr(10) || p.page else p.page end,
          case when (p.page is null or not (s.buf <> '' and length(s.buf) + length(p.page) < 1500)) and length({dv.sql_strip('s.buf')}) >= 150 then {dv.sql_strip('s.buf')} end
        from s join z using (doc_id) left join p on p.doc_id = s.doc_id and p.i = s.i + 1 where s.i <= z.n)
      select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as chunk_no, done as text from s where done is not null""",
    "chk15_element_context": f"""with {dv.SQL_ELEMENTS},
      pg as (select doc_id, page_num, list(text order by line_no) as ls from elements group by all),
      e as (select chunk_id, element_type, number, text, substring(text, 1, 12) as latex, case when element_type = 'table' then substring(text, 1, 30) else substring(text, 5, 30) end as caption, ls
        from elements join pg using (doc_id, page_num)),
      f as (select *, list_position(list_transform(ls, lambda l: latex <> '' and (contains(l, text) or contains(l, latex))), true) as eq,
        list_position(list_transform(ls, lambda l: contains(l, caption) and (caption <> '' or element_type = 'table')), true) as cap,
        list_filter(range(1, len(ls) + 1), lambda i: contains(ls[i], 'Figure ' || number) or contains(ls[i], 'Fig. ' || number) or contains(ls[i], 'Fig ' || number) or contains(ls[i], 'figure ' || number)) as spots from e),
      g as (select *, list_concat(case when coalesce(cap, 0) > 0 then [array_to_string(ls[greatest(cap - 5, 1):cap + 5], ' ')] else []::varchar[] end,
        list_transform(list_filter(spots, lambda i: i <> coalesce(cap, 0)), lambda i: array_to_string(ls[greatest(i - 2, 1):i + 2], ' '))) as fig from f)
      select chunk_id, case when element_type = 'equation' and coalesce(eq, 0) > 0 then array_to_string(ls[greatest(eq - 6, 1):eq + 6], ' ')
        when element_type = 'table' and coalesce(cap, 0) > 0 then array_to_string(ls[greatest(cap - 2, 1):cap + 2], ' ')
        when element_type = 'figure' and len(fig) > 0 then array_to_string(list_filter(fig, lambda x, i: list_position(fig, x) = i), ' ')
        else array_to_string(ls, chr(10)) end as context from g""",
}
