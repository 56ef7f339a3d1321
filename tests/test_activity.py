import datetime as dt
import random

from pyspark.sql import functions as F

from litmill.functions import skew
from litmill.functions.skew import numbered, previous, running_sum
from litmill.operators import history, metrics, papers, review, validation
from litmill.sources import model_output


def test_bucketed_windows_equal_plain_ones(spark):
    from pyspark.sql import Window

    rnd = random.Random(2)
    df = spark.createDataFrame([("k" if rnd.random() < 0.7 else "m", rnd.randint(0, 99), i, rnd.choice("ab")) for i in range(300)], "k string, t int, i int, d string")
    w = Window.partitionBy("k").orderBy("t", "i")
    bucket = F.floor(F.col("t") / 10)
    df = previous(running_sum(numbered(df, ["k"], ["t", "i"], bucket), ["k"], ["t", "i"], F.col("i"), bucket, "s"), ["k"], ["t", "i"], "d", bucket, "p")
    rows = df.select("*", F.row_number().over(w).alias("n2"), F.sum("i").over(w).alias("s2"), F.lag("d").over(w).alias("p2")).collect()
    assert all(r.row_no == r.n2 and r.s == r.s2 and r.p == r.p2 for r in rows)


def test_near_titles_equal_brute_force(spark):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(8, 40))) for _ in range(15)]
    texts = set(base)
    for b in base:
        s = list(b)
        for _ in range(rnd.randint(1, 4)):
            s[rnd.randrange(len(s))] = rnd.choice("abcdez")
        texts.add("".join(s))
        texts.add(b + "x")
    got = {tuple(sorted((r.a, r.b))) for r in papers.close_titles(spark.createDataFrame([(t,) for t in texts], "t string")).collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    ts = sorted(texts)
    want = {(a, b) for i, a in enumerate(ts) for b in ts[i + 1 :] if 1 - lev(a, b) / max(len(a), len(b)) >= 0.9}
    assert got == want


def test_titles_of_a_series_meet_only_near_ones(spark):
    """Titles that differ in a number are not all compared: their pieces part the number, not the common words."""
    texts = [f"buildingstudynumber{10_000 + 7 * i}" for i in range(2000)]
    index, probe = papers._pieces(spark.createDataFrame([(t,) for t in texts], "t string"))
    assert index.join(probe, ["m", "n", "i", "piece"]).count() < 0.4 * 2000 * 2000


def test_first_near_title_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(papers, "EARLY", 1)
    rnd = random.Random(8)
    names = [rnd.choice(["building study no ", "furniture study ", "x", "!"]) + str(rnd.randint(0, 3000)) for _ in range(150)]
    rows = [(rnd.randint(1, 400) if rnd.random() < 0.95 else None, None, name, [], "2000") for name in [*names, *names[:40], None, "", "?!"]]
    df = spark.createDataFrame(rows, "paper_id long, doi string, title string, authors array<string>, year string")
    got = sorted((r.paper_id, r.duplicate_of) for r in papers.fuzzy_duplicates(df).collect())
    texts = {t: "".join(c for c in t.lower() if c.isalnum()) for _, _, t, _, _ in rows if t}
    close = {tuple(sorted((r.a, r.b))) for r in papers.close_titles(spark.createDataFrame([(t,) for t in texts.values()], "t string")).collect()}
    near = lambda a, b: a == b or tuple(sorted((a, b))) in close
    want = []
    for i, _, t, _, _ in rows:
        ids = [j for j, _, u, _, _ in rows if t and u and j is not None and near(texts[t], texts[u])]
        if i is not None and ids and min(ids) < i:
            want.append((i, min(ids)))
    assert want and got == sorted(want)


def test_upserts_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 50)
    schema = "id long, owner long, updated_at int, price double"
    base = spark.createDataFrame([(i, i % 7, 10, 1.0) for i in range(600)], schema)
    changes = spark.createDataFrame([(i, i % 7, t, float(t)) for i in range(300, 700) for t in (5, 10, 12)], schema)
    out = history.upsert_documents(base, changes)
    assert out.rdd.getNumPartitions() >= (600 + 1200) // 50
    assert {(r.id, r.updated_at, r.price) for r in out.collect()} == {(i, 10, 1.0) for i in range(300)} | {(i, 12, 12.0) for i in range(300, 700)}


def test_merge_papers_last_enriches_first_stays(spark):
    schema = "paper_id long, pos long, title string, authors array<string>, citations long, topic_tags array<string>, venue string"
    left = spark.createDataFrame([(1, 0, "Deep Nets!", ["A"], 0, ["x"], None)], schema)
    right = spark.createDataFrame([(2, 0, "deep nets", ["B"], 5, [], "V1"), (3, 1, "Deep  nets", ["C"], 9, [], "V2"), (4, 2, "Other", [], 1, [], None), (5, 3, "other", [], 2, [], None)], schema)
    rows = {r.paper_id: r for r in papers.merge_papers(left, right).collect()}
    assert set(rows) == {1, 4} and (rows[1].citations, rows[1].venue, rows[1].authors, rows[1].topic_tags) == (9, "V2", ["C"], ["x"])


def test_references_move_to_nearest_or_are_marked(spark):
    reg = spark.createDataFrame([(1, "equation", 1, "e1"), (1, "equation", 3, "e3"), (1, "table", 1, "t1")], "doc_id long, element_type string, number long, chunk_id string")
    r = spark.createDataFrame([(9, 1, "Equation 5, eq. 3, Table 3 and Figure 9")], "response_id long, doc_id long, text string")
    assert validation.correct_refs(r, reg).first().text == "Equation 3, eq. 3, Table 1 and [Figure NOT FOUND]"


def test_near_equations_keep_highest_confidence(spark):
    e = spark.createDataFrame([(1, "a", "E = m c^2 + 1000", 0.5), (1, "b", "E=mc^2+1001", 0.9), (1, "c", "E=mc^2+1000", 0.2), (2, "d", "x", 0.1)], "doc_id long, eq_id string, latex string, confidence double")
    assert sorted(r.eq_id for r in history.dedup_equations(e).collect()) == ["b", "d"]


def test_quota_spans_and_status(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "m", t0 + dt.timedelta(seconds=20 * i), 100) for i in range(6)]
    df = spark.createDataFrame(rows, "request_id long, key string, ts timestamp, tokens long")
    out = {r.request_id: r for r in history.quota_usage(df, {"requests_minute": 3, "tokens_minute": 10_000}).collect()}
    assert [out[i].requests_minute for i in range(6)] == [0, 1, 2, 3, 3, 3]
    assert out[3].status == "wait" and out[5].tokens_day == 500


def test_quantile_interpolates_inside_bucket(spark):
    df = spark.createDataFrame([(v,) for v in [0.2, 0.3, 0.4, 3.0]], "value double")
    row = metrics.bucket_quantile(df.withColumn("k", F.lit(1)), ["k"], qs=(0.5,)).first()
    assert abs(row.p50 - (0.1 + 0.4 * 2 / 3)) < 1e-9


def test_repaired_json_and_triples(spark):
    df = spark.createDataFrame([(1, '[{"a": 1}, {"b": "x} y'), (2, '```json\n{"a": 1}\n```'), (3, '{"a": "]"}')], "response_id long, raw string")
    got = {r.response_id: (r.json, r.parsed) for r in model_output.repair_json(df).collect()}
    assert got == {1: ('[{"a": 1}]', True), 2: ('{"a": 1}', True), 3: ('{"a": "]"}', True)}
    raw = 'x {"entities": [{"id": "A", "type": ""}], "relations": [{"source": "A", "target": "B", "predicate": "is a", "evidence": ""}]} y'
    bad = '{"entities": [{"id": "A"}], "relations": []}'
    rows = model_output.parse_triples(spark.createDataFrame([(1, raw), (2, bad), (3, "{oops"), (4, None)], "chunk_id long, raw string")).collect()
    assert [(r.head, r.head_type, r.relation, r.tail, r.evidence) for r in rows] == [("A", "Concept", "IS_A", "B", None)]


def test_evidence_prefers_concrete_and_one_per_metric(spark):
    items = ["- accuracy of 91.5% on the benchmark", "accuracy of 91.5% again in other words", "a thorough analysis of it all", "short", "nothing concrete in this one", "does not report the learning rate"]
    df = spark.createDataFrame([(items,)], "e array<string>")
    assert df.select(review.clean_evidence(F.col("e")).alias("x")).first()[0] == ["accuracy of 91.5% on the benchmark", "does not report the learning rate"]


def test_contradicted_evidence_goes(spark):
    df = spark.createDataFrame([(["not evaluated on glue", "glue accuracy 91.5%", "not tested on wmt"],)], "evidence array<string>")
    assert review.consistent_evidence(df).first()[0] == ["glue accuracy 91.5%", "not tested on wmt"]


def test_profiles_and_comparison(spark):
    base = dict(abstract="", introduction="", methodology="", results="", conclusion="", limitations="", future_work="")
    strong = {**base, "results": "Accuracy improves to 91.5% on the benchmark dataset. It outperforms the baseline by 3 points."}
    df = spark.createDataFrame([(1, *strong.values()), (2, *base.values())], "paper_id long, " + ", ".join(f"{k} string" for k in base))
    profiles = review.paper_profiles(df)
    assert profiles.count() == 16
    pairs = spark.createDataFrame([(1, 1, 2)], "pair_id long, paper_a long, paper_b long")
    got = {r.dimension: r.judgement for r in review.compare_profiles(pairs, profiles).collect()}
    assert got["strengths"].startswith("Paper A appears stronger") and got["assumptions"].startswith("Insufficient")


def test_verdict_vocabulary(spark):
    df = spark.createDataFrame([("strengths", "Some strengths are supported by data"), ("novelty", "nothing"), ("novelty", "incremental extension of prior work")], "dimension string, verdict string")
    got = [r.verdict for r in review.enforce_vocab(df).collect()]
    assert got == ["Some strengths are supported, others are partial", "Not enough evidence", "Incremental extension of prior work"]
