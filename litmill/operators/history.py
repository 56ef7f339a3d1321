"""Chat, workspace and registry history; set operations; lookups of numbered elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litmill.functions import fixed_values as fv
from litmill.functions.skew import first_rows, last_rows, numbered, previous, running_sum, running_sums, spread, top_k
from litmill.functions.text import contains_any, strip, words
from litmill.operators.cleaning import without_doubled_half
from litmill.operators.lines import is_equation, is_heading
from litmill.session import cut_lineage

# ---- chat ------------------------------------------------------------------------------------------


def recent_context(turns: DataFrame, n: int = 3, include_failed: bool = False) -> DataFrame:
    """(conv_id, turn, role, content): the last ``n`` valid turns of each conversation as messages."""
    valid = turns if include_failed else turns.where("response_valid")
    last = top_k(valid, ["conv_id"], [F.col("turn").desc()], n, "_r")
    messages = F.array(
        F.struct(F.lit("user").alias("role"), F.col("user_query").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("assistant_response").alias("content")),
    )
    return last.select("conv_id", "turn", F.explode(messages).alias("m")).select("conv_id", "turn", "m.role", "m.content")


def history_segments(turns: DataFrame, key: str, order: list[str], document: str, bucket: Column) -> DataFrame:
    """Adds ``segment``: 0, 1, 2, ... per key, one more whenever the document changes."""
    before = previous(turns, [key], order, document, bucket, "_before")
    changed = (F.col("_before").isNotNull() & (F.col("_before") != F.col(document))).cast("bigint")
    return running_sum(before, [key], order, changed, bucket, "segment").drop("_before")


def number_rows(df: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str = "number") -> DataFrame:
    """Turn or version numbers per key, for keys of any size."""
    return numbered(df, keys, order, bucket, out)


def chat_stats(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(
        F.count("*").alias("total_turns"),
        F.count_if("response_valid").alias("valid_turns"),
        F.count_if(~F.col("response_valid")).alias("failed_turns"),
        F.avg("retrieval_score").alias("avg_retrieval_score"),
        F.max("turn").alias("latest_turn"),
    )


def session_titles(messages: DataFrame) -> DataFrame:
    """(conv_id, title, last_turn): first 50 characters of the first user message and the last activity."""
    user = F.col("role") == "user"
    m = messages.groupBy("conv_id").agg(
        F.min_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("first"), F.max("turn").alias("last_turn")
    )
    title = F.when(F.length("first") > 50, F.concat(F.substring("first", 1, 50), F.lit("..."))).otherwise(F.col("first"))
    return m.select("conv_id", title.alias("title"), "last_turn")


def transcript(messages: DataFrame, keep_system: bool = False) -> DataFrame:
    """(conv_id, turn, role, content) with the roles user and ai, in order inside every output partition."""
    m = messages if keep_system else messages.where("role != 'system'")
    role = F.when(F.col("role") == "user", "user").otherwise("ai")
    rows = m.select("conv_id", "turn", role.alias("role"), F.col("text").alias("content"))
    return rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn")


# ---- workspace -----------------------------------------------------------------------------------------


def workspace_tables(users: DataFrame, files: DataFrame, sessions: DataFrame, searches: DataFrame) -> DataFrame:
    """(owner, name, n_files, n_sessions, n_searches): what every user owns. Children are counted before the join."""
    count = lambda df, name: df.groupBy("owner").agg(F.count("*").alias(name))
    out = users.select("owner", "name")
    for df, name in ((files.where("not is_deleted"), "n_files"), (sessions, "n_sessions"), (searches, "n_searches")):
        out = out.join(count(df, name), "owner", "left")
    return out.fillna(0, ["n_files", "n_sessions", "n_searches"])


def cascade_delete(children: DataFrame, deleted: DataFrame, key: str = "owner") -> DataFrame:
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def workspace_summary(files: DataFrame, sessions: DataFrame, searches: DataFrame) -> DataFrame:
    """(owner, file_count, session_count, recent_files, recent_sessions, recent_searches).

    files: owner, id, uploaded_at, is_deleted; sessions: owner, id, last_message_at; searches: owner, id, ts.
    The lists hold the 5, 5 and 10 newest ids; only those rows are gathered.
    """

    def newest(df: DataFrame, at: str, n: int, out: str) -> DataFrame:
        best = top_k(df, ["owner"], [F.col(at).desc_nulls_last(), F.col("id").desc()], n, "_r")
        listed = best.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("_r", "id"))).alias("l"))
        return listed.select("owner", F.transform("l", lambda x: x["id"]).alias(out))

    live = files.where("not is_deleted")
    counts = live.groupBy("owner").agg(F.count("*").alias("file_count")).join(
        sessions.groupBy("owner").agg(F.count("*").alias("session_count")), "owner", "full_outer"
    )
    out = counts.join(newest(live, "uploaded_at", 5, "recent_files"), "owner", "full_outer")
    out = out.join(newest(sessions, "last_message_at", 5, "recent_sessions"), "owner", "full_outer")
    out = out.join(newest(searches, "ts", 10, "recent_searches"), "owner", "full_outer")
    return out.fillna(0, ["file_count", "session_count"])


def keyset_page(df: DataFrame, at: str, cursor: str | None = None, limit: int = 20, where: Column | None = None) -> DataFrame:
    """Rows strictly before the cursor, newest first; 1 to 100 of them. The filter reaches the scan."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    if where is not None:
        df = df.where(where)
    if cursor is not None:
        df = df.where(F.col(at) < F.lit(cursor).cast("timestamp"))
    return df.orderBy(F.col(at).desc_nulls_last(), *[c for c in df.columns if c != at]).limit(limit)


def upsert_documents(base: DataFrame, changes: DataFrame, keys: list[str] | None = None, at: str = "updated_at") -> DataFrame:
    """Base rows with changes applied: the last write per id and owner wins, changes over equal times.

    All rows are written once, so that their number gives the tasks.
    """
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    both, keys = cut_lineage(both), keys or ["id", "owner"]
    return last_rows(spread(both, keys, both.count()), keys, [at, "_new"]).drop("_new")


def apply_deletes(base: DataFrame, deletes: DataFrame) -> DataFrame:
    """base: id, owner, is_deleted; deletes: action (soft, hard, clear), id, owner. Hard deletes and cleared owners
    go, soft deletes are flagged."""
    only = lambda a, *ks: deletes.where(F.col("action") == a).select(*ks).distinct()
    left = base.join(only("hard", "id", "owner"), ["id", "owner"], "left_anti").join(only("clear", "owner"), "owner", "left_anti")
    soft = only("soft", "id", "owner").withColumn("_soft", F.lit(True))
    return left.join(soft, ["id", "owner"], "left").withColumn("is_deleted", F.col("is_deleted") | F.col("_soft").isNotNull()).drop("_soft")


# ---- quotas ----------------------------------------------------------------------------------------------


def quota_usage(requests: DataFrame, limits: dict[str, int] | None = None, margin: float = fv.QUOTA_MARGIN, bucket: str = "hour") -> DataFrame:
    """Every request with the usage of its key before it and the decision.

    requests: request_id, key, ts, tokens. Adds requests_minute, tokens_minute, tokens_day, tokens_month over the
    trailing minute, day and 30 days, and status (allowed, wait, blocked).
    Trailing sums are differences of running totals at two moments, so a key may hold any share of the rows:
    each request is a row and four probes of the running totals.
    """
    lim = {**fv.QUOTA, **(limits or {})}
    micro = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = {"now": 0, "minute": 60, "day": 86_400, "month": 30 * 86_400}
    points = [F.struct(F.lit("row").alias("kind"), micro.alias("us"), F.lit(1).alias("after"), F.col("tokens").alias("v"), F.lit(1).alias("c"))]
    points += [
        F.struct(F.lit(n).alias("kind"), (micro - s * 1_000_000).alias("us"), F.lit(0).alias("after"), (F.col("tokens") * 0).alias("v"), F.lit(0).alias("c"))
        for n, s in spans.items()
    ]
    rows = requests.select("request_id", "key", F.explode(F.array(*points)).alias("p")).select("request_id", "key", "p.*")
    hour = F.floor(F.col("us") / (3_600_000_000 if bucket == "hour" else 86_400_000_000))
    sums = running_sums(rows, ["key"], ["us", "after", "request_id", "kind"], {"tv": F.col("v"), "tc": F.col("c")}, hour).where("kind != 'row'")
    at = lambda col, kind: F.max(F.when(F.col("kind") == kind, F.col(col)))
    use = sums.groupBy("request_id").agg(
        (at("tc", "now") - at("tc", "minute")).alias("requests_minute"),
        *[(at("tv", "now") - at("tv", s)).alias(f"tokens_{s}") for s in ("minute", "day", "month")],
    )
    out = requests.join(use, "request_id")
    left = lambda span: lim[f"tokens_{span}"] - int(lim[f"tokens_{span}"] * margin) - F.col(f"tokens_{span}")
    spent = lambda span: (F.col("tokens") > left(span)) & (left(span) <= 0)
    status = (
        F.when(spent("day") | spent("month"), "blocked")
        .when((F.col("requests_minute") >= lim["requests_minute"]) | (F.col("tokens_minute") + F.col("tokens") > lim["tokens_minute"]), "wait")
        .otherwise("allowed")
    )
    return out.withColumn("status", status)


# ---- sets ------------------------------------------------------------------------------------------------


def first_distinct(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; copies are reduced where they are read."""
    return first_rows(df, keys, order)


def novel_evidence(pairs: DataFrame, evidence: DataFrame, raw: DataFrame) -> DataFrame:
    """Raw evidence of a pair that neither paper's profile holds. pairs: pair_id, paper_a, paper_b; evidence:
    paper_id, text; raw: pair_id, text."""
    known = pairs.select("pair_id", F.explode(F.array("paper_a", "paper_b")).alias("paper_id")).join(evidence, "paper_id")
    return raw.join(known.select("pair_id", "text").distinct(), ["pair_id", "text"], "left_anti").distinct()


def add_missing(base: DataFrame, extra: DataFrame, keys: list[str], text: str, order: list[str]) -> DataFrame:
    """Base rows and, after them, rows of ``extra`` whose trimmed text the base lacks, each text once."""
    known = base.select(*keys, strip(F.col(text)).alias("_t")).distinct()
    new = extra.withColumn("_t", strip(F.col(text))).join(known, [*keys, "_t"], "left_anti")
    new = first_rows(new, [*keys, "_t"], order).drop("_t")
    return base.withColumn("added", F.lit(False)).unionByName(new.withColumn("added", F.lit(True)))


# ---- numbered elements ----------------------------------------------------------------------------------------


def lookup_element(refs: DataFrame, registry: DataFrame, any_document: bool = False) -> DataFrame:
    """References with the chunk of their element: in the own document, or the smallest chunk id of any."""
    if not any_document:
        return refs.join(registry.select("doc_id", "element_type", "number", "chunk_id"), ["doc_id", "element_type", "number"])
    found = registry.groupBy("element_type", "number").agg(F.min("chunk_id").alias("chunk_id"))
    return refs.join(found, ["element_type", "number"])


def nearest_element(refs: DataFrame, registry: DataFrame) -> DataFrame:
    """refs (doc_id, element_type, number) with ``nearest``: the closest existing number of the type in the document,
    the smaller one on a tie, null when the type is empty.

    Numbers are gathered as runs (first, last) per document and type, so a dense registry stays small.
    """
    nums = registry.select("doc_id", "element_type", "number").distinct()
    w = Window.partitionBy("doc_id", "element_type").orderBy("number")
    runs = nums.withColumn("g", F.col("number") - F.row_number().over(w)).groupBy("doc_id", "element_type", "g").agg(
        F.min("number").alias("lo"), F.max("number").alias("hi")
    )
    asked = refs.select("doc_id", "element_type", "number").distinct()
    near = asked.join(runs, ["doc_id", "element_type"], "left")
    n = F.col("number")
    close = F.when(F.col("lo").isNull(), F.lit(None).cast("bigint")).when(n < F.col("lo"), F.col("lo")).when(n > F.col("hi"), F.col("hi")).otherwise(n)
    best = near.groupBy("doc_id", "element_type", "number").agg(F.min_by(close, F.struct(F.abs(close - n), close)).alias("nearest"))
    return refs.join(best, ["doc_id", "element_type", "number"])


def dedup_equations(equations: DataFrame) -> DataFrame:
    """Equations (doc_id, eq_id, latex, confidence) without near copies in their document, by falling confidence.

    Equal normalised texts are one equation; texts over 10 characters with more than 90 % equal characters at
    equal places are, too. The order of confidence decides, so kept rows of a document are folded in its array.
    """
    norm = F.regexp_replace(F.lower("latex"), r"\s+", "")
    best = first_rows(equations.withColumn("norm", norm).withColumn("_c", -F.col("confidence")), ["doc_id", "norm"], ["_c", "eq_id"])
    rows = best.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("_c", "eq_id", "norm", "latex", "confidence"))).alias("e"))

    def alike(a: Column, b: Column) -> Column:
        same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
        longest = F.greatest(F.length(a), F.length(b))
        # Longer texts can only be 90 % alike when their lengths are.
        near = F.least(F.length(a), F.length(b)) > longest * 0.9
        return (F.length(a) > 10) & (F.length(b) > 10) & near & (same / longest > 0.9)

    kept = F.aggregate(
        "e",
        F.slice("e", 1, 0),
        lambda acc, x: F.when(F.exists(acc, lambda k: alike(k["norm"], x["norm"])), acc).otherwise(F.array_append(acc, x)),
    )
    return rows.select("doc_id", F.explode(kept).alias("k")).select("doc_id", "k.eq_id", "k.latex", "k.confidence")


def number_elements(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_num, block_no, element_type, number, text, section): captions and equations of a document numbered in
    reading order under the section heading before them. blocks: doc_id, page_num, block_no, text."""
    t = strip(F.coalesce(F.col("text"), F.lit("")))
    kind = (
        F.when(t.rlike(r"(?i)^\s*(Figure|Fig\.)\s*\d+"), "figure").when(is_heading(t), "section").when(is_equation(t), "equation")
    )
    rows = blocks.withColumn("text", t).where("text != ''").withColumn("element_type", kind).where("element_type is not null")
    w = Window.partitionBy("doc_id").orderBy("page_num", "block_no")
    section = F.last(F.when(F.col("element_type") == "section", F.col("text")), ignorenulls=True).over(w)
    number = F.row_number().over(Window.partitionBy("doc_id", "element_type").orderBy("page_num", "block_no"))
    placed = rows.withColumn("section", F.coalesce(section, F.lit(""))).withColumn("number", number).where("element_type != 'section'")
    text = F.when(F.col("element_type") == "equation", without_doubled_half(F.col("text"))).otherwise(F.replace("text", F.lit("\n"), F.lit(" ")))
    return placed.select("doc_id", "page_num", "block_no", "element_type", "number", text.alias("text"), "section")


# ---- counts and evaluation -----------------------------------------------------------------------------------------


def chunk_counts(chunks: DataFrame, kinds: list[str]) -> DataFrame:
    """(doc_id, total, one column per kind); the kinds are given, so nothing is collected to find them."""
    return chunks.groupBy("doc_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("chunk_type") == k).alias(f"n_{k}") for k in kinds])


def element_catalogue(elements: DataFrame) -> DataFrame:
    """(doc_id, element_type, catalogue): a count line and one line per element in number order."""
    name = F.concat(F.initcap("element_type"), F.lit(" "), F.col("number").cast("string"))
    line = F.concat(F.lit("- "), name, F.lit(" (Page "), F.col("page_num").cast("string"), F.lit(")"))
    caption = F.trim(F.coalesce("caption", F.lit("")))
    listed = (F.col("element_type") != "equation") & (caption != "") & (F.lower(caption) != F.lower(name))
    line = F.when(listed, F.concat(line, F.lit(": "), caption)).otherwise(line)
    rows = elements.groupBy("doc_id", "element_type").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("number", "page_num", line.alias("line")))).alias("l")
    )
    head = F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" "), F.col("element_type"), F.lit("s in the document.\n\n"))
    return rows.select("doc_id", "element_type", F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("catalogue"))


def evaluate_answers(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, category, hit_rate, faithfulness, exact_match, passed).

    answers: case_id, answer, sources (array). cases: case_id, category, expected (array), context (array),
    exact_match (nullable), is_negative_control.
    """
    rows = cases.join(answers, "case_id")
    answer = F.lower(F.coalesce("answer", F.lit("")))
    context = F.concat_ws(" ", answer, F.lower(F.array_join("sources", " ")))

    def share(wanted: str, text: Column) -> Column:
        hits = F.size(F.filter(wanted, lambda w: F.contains(text, F.lower(w))))
        return F.when(F.size(wanted) > 0, hits / F.greatest(F.size(wanted), F.lit(1))).otherwise(1.0)

    faith = F.when(F.col("is_negative_control"), F.when(contains_any(answer, fv.REFUSALS), 1.0).otherwise(0.0)).otherwise(
        F.when(contains_any(answer, fv.DENIALS), 0.0).otherwise(share("expected", answer))
    )
    exact = F.when(F.col("exact_match").isNotNull(), F.contains(F.coalesce("answer", F.lit("")), F.col("exact_match")).cast("double"))
    out = rows.select("case_id", "category", share("context", context).alias("hit_rate"), faith.alias("faithfulness"), exact.alias("exact_match"))
    return out.withColumn("passed", (F.col("hit_rate") >= 0.5) & (F.col("faithfulness") >= 0.5))


def evaluation_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("category").agg(
        F.count("*").alias("cases"), F.avg("hit_rate").alias("hit_rate"), F.avg("faithfulness").alias("faithfulness"),
        F.avg("exact_match").alias("exact_match"), F.count_if("passed").alias("passed"),
    )


def answer_quality(answers: DataFrame) -> DataFrame:
    """Adds completeness, relevance, clarity, conciseness and overall to (query, response)."""
    r, q = F.col("response"), F.col("query")
    n = F.length(r)
    complete = F.when(F.length(strip(r)) > 100, F.least(F.lit(1.0), n / 500)).otherwise(0.0)
    qw, rw = F.array_distinct(words(F.lower(q))), F.array_distinct(words(F.lower(r)))
    relevance = F.least(F.lit(1.0), F.size(F.array_intersect(qw, rw)) / F.greatest(F.size(qw), F.lit(1)))
    sentences = F.size(F.split(r, "[.!?]+", -1))
    clarity = 1.0 / (1 + F.size(words(r)) / F.greatest(sentences, F.lit(1)) / 20)
    concise = F.when(n > 1000, F.greatest(F.lit(0.5), 1.0 - (n - 1000) / 2000)).otherwise(1.0)
    out = answers.withColumns({"completeness": complete, "relevance": relevance, "clarity": clarity, "conciseness": concise})
    return out.withColumn("overall", (F.col("completeness") + F.col("relevance") + F.col("clarity") + F.col("conciseness")) / 4)


def quiz_scores(answers: DataFrame, items: DataFrame) -> DataFrame:
    """(attempt_id, answered, correct, score): trimmed matches in any case. answers: attempt_id, item_id, answer."""
    rows = answers.select("attempt_id", "item_id", "answer").join(items.select("item_id", F.col("answer").alias("right")), "item_id")
    ok = F.lower(F.trim("answer")) == F.lower(F.trim("right"))
    out = rows.groupBy("attempt_id").agg(F.count("*").alias("answered"), F.count_if(ok).alias("correct"))
    return out.withColumn("score", F.col("correct") / F.col("answered"))


# ---- merging extracted sections -------------------------------------------------------------------------------------------

SECTION_FIELDS = ["title", "authors", "abstract", "introduction", "methodology", "results", "conclusion", "limitations", "future_work"]


def richness(c: Column) -> Column:
    """Longer values with digits, percent signs and deviations score higher; generic openers lose 20."""
    t = F.coalesce(c, F.lit(""))
    low = F.lower(strip(t))
    count = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    score = F.length(t) * 0.5 + count(r"\d") * 8 + count("%") * 15 + count("±") * 10
    generic = F.lit(False)
    for g in fv.GENERIC_OPENERS:
        generic = generic | low.startswith(g)
    return F.when((low == "") | (low == "not found"), 0.0).otherwise(score - F.when(generic, 20).otherwise(0))


def merge_sections(extractions: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(paper_id, one column per field): over the chunks of a paper the richest value, "Not found" without one.

    One aggregate over all fields: each keeps its best value on the map side.
    """
    fields = fields or SECTION_FIELDS

    def best(f: str) -> Column:
        value = F.when(~F.lower(strip(F.coalesce(F.col(f), F.lit("")))).isin("", "not found"), F.col(f))
        pick = F.min_by(value, F.when(value.isNotNull(), F.struct(-richness(F.col(f)), F.col("chunk_idx"))))
        return F.coalesce(pick, F.lit(fv.NOT_FOUND)).alias(f)

    return extractions.groupBy("paper_id").agg(*[best(f) for f in fields])


def merge_key_figures(figures: DataFrame) -> DataFrame:
    """(paper_id, label, value, context, section): distinct by label and value in any case, the best section first.

    figures: paper_id, pos, label, value, context, section.
    """
    order = F.coalesce(*[F.when(F.lower(F.coalesce("section", F.lit(""))) == s, F.lit(i)) for i, s in enumerate(fv.FIGURE_SECTIONS)], F.lit(99))
    rows = figures.where("coalesce(label, '') != '' and coalesce(value, '') != ''").withColumns(
        {"_s": order, "_l": F.lower(strip(F.col("label"))), "_v": F.lower(strip(F.col("value")))}
    )
    return first_rows(rows, ["paper_id", "_l", "_v"], ["_s", "pos"]).select("paper_id", "label", "value", "context", "section")
