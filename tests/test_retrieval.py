import random

import numpy as np
from pyspark.sql import functions as F

from litmill.operators import fusion, graph, lexical, postings, queries, vectors


def test_knn_blocks_agree_with_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 8))
    vec = spark.createDataFrame([(i, v[i].tolist(), "a" if i % 2 else "b") for i in range(200)], "chunk_id long, embedding array<double>, chunk_type string")
    q = vec.where("chunk_id < 20").select(F.col("chunk_id").alias("query_id"), "embedding")
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id) for r in df.collect())
    near, blocks = vectors.knn(q, vec, 5), vectors.knn(q, vec, 5, question_mb=0.0005, vector_mb=0.002)
    assert key(near) == key(blocks)
    for i in range(20):
        want = np.lexsort((np.arange(200), -np.round(v @ v[i], 9)))[:5].tolist()
        assert [c for qq, _, c in key(near) if qq == i] == want
    only = vectors.knn(q.withColumn("want", F.lit("a")), vec, 5)
    assert all(r.chunk_id % 2 for r in only.collect())


def test_knn_more_than_the_store_and_empty_store(spark):
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id long, embedding array<double>")
    q = vec.where("chunk_id = 1").select(F.col("chunk_id").alias("query_id"), "embedding")
    assert vectors.knn(q, vec, 10).count() == 2
    assert vectors.knn(q, vec.where("false"), 10).count() == 0


def test_boosted_scores_reach_unmatched_elements(spark):
    c = spark.createDataFrame(
        [("a", "text about apples", "text", None, 1.0), ("b", "zzz", "table", 3, 1.3), ("c", "yyy", "figure", 4, 1.2), ("d", "pineapples here", "text", None, 1.0)],
        "chunk_id string, text string, chunk_type string, number long, content_priority double",
    )
    q = spark.createDataFrame([(1, "apples 3")], "query_id long, query string")
    rows = {r.chunk_id: round(r.score, 6) for r in lexical.bm25_boosted(q, c, lexical.lexical_index(c), 4).collect()}
    assert rows["b"] == round(0.25 + 1.3 * 0.02, 6) and rows["c"] == round(1.2 * 0.02, 6)
    assert rows["d"] == 0.05 and rows["a"] > 0.05


def test_rrf_ignores_input_order(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id long, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id long, chunk_id string, rank int")
    one = [tuple(r) for r in fusion.rrf([a, b]).orderBy("rank").collect()]
    assert one == [tuple(r) for r in fusion.rrf([b, a]).orderBy("rank").collect()]
    assert one[0][1] == "y"


def test_graph_bonus_and_order(spark):
    q = spark.createDataFrame([(1, "attention model")], "query_id long, query string")
    c = spark.createDataFrame(
        [(1, "v", "attention model works", "Vector Chunk", 0.1), (1, "g", "attention model works", "Knowledge Graph", 0.1), (1, "n", "nothing", "Vector Chunk", 0.1)],
        "query_id long, id string, text string, source_type string, score double",
    )
    assert [r.id for r in fusion.rerank_ngrams(q, c, 3).orderBy("rank").collect()] == ["g", "v", "n"]


def test_intents(spark):
    cases = {
        "": "general", "Show table 3": "specific_element", "list all figures": "list_all", "compare tables 1 and 2": "comparison",
        "relation between a and b": "cross_reference", "which formula and variable": "equation", "hello there": "general",
    }
    df = spark.createDataFrame([(k,) for k in cases], "query string")
    got = {r.query: r for r in queries.classify_queries(df).collect()}
    assert {k: r.query_type for k, r in got.items()} == cases
    assert got["Show table 3"].target_number == 3 and got["compare tables 1 and 2"].target_numbers == [1, 2]


def test_seeds_and_variants(spark):
    q = spark.createDataFrame([(1, 'What is "Beam Search" in the Transformer model?')], "query_id long, query string")
    assert [r.term for r in queries.seed_terms(q).orderBy("pos").collect()][:3] == ["Beam Search", "What", "Transformer"]
    v = [r.query for r in queries.query_variants(spark.createDataFrame([(1, "What is LoRA?")], "query_id long, query string")).orderBy("variant_no").collect()]
    assert v == ["What is LoRA?", "LoRA", "LoRA definition", "what is LoRA"] or v == ["What is LoRA?", "LoRA", "LoRA definition"]


def test_decompose(spark):
    q = spark.createDataFrame([(1, "Compare BERT and GPT"), (2, "table 2 and equation 3"), (3, "plain")], "query_id long, query string")
    rows = queries.decompose(q).orderBy("query_id", "pos").collect()
    assert [r.sub_query for r in rows] == [
        "What is bert?", "What is gpt?", "Compare bert and gpt", "Show table 2", "Show equation 3", "Relate the results from table 2 to equation 3", "plain",
    ]
    assert rows[2].dependencies == [0, 1]


def test_similar_queries_equal_brute_force(spark):
    import itertools, random

    rnd = random.Random(5)
    words = "the of a model table data deep net loss".split()
    texts = [" ".join(rnd.sample(words, rnd.randint(2, 6))) for _ in range(60)]
    h = spark.createDataFrame([(t, t + "!", 0.5) for t in set(texts[:40])], "past_query string, expansion string, score double")
    q = spark.createDataFrame(list(enumerate(texts[40:])), "query_id long, query string")
    got = {(r.query_id, r.past_query) for r in queries.similar_queries(q, h, keep=1000).collect()}
    want = set()
    for (i, a), b in itertools.product(enumerate(texts[40:]), set(texts[:40])):
        x, y = set(a.split()), set(b.split())
        if len(x & y) / max(len(x), len(y)) > 0.5:
            want.add((i, b))
    assert got == want


def entities(spark, *names):
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(names)], "pos long, name string, type string")


def test_aliases_and_dedup(spark):
    e = entities(spark, ("Recurrent Neural Network (RNN)", "M"), ("RNN", "M"), ("Long Short-Term Memory", "M"), ("LSTM", "M"), ("28.4", "X"), ("", "X"), ("BLEU", "Metric"), ("BLEU", "Score"))
    a = {r.alias: r.canonical for r in graph.alias_map(e.where("name <> ''").select("pos", "name")).collect()}
    assert a["rnn"] == "Recurrent Neural Network" and a["lstm"] == "Long Short-Term Memory"
    got = sorted((r.name, r.type) for r in graph.dedupe_entities(e).collect())
    assert got == [("BLEU", "Metric"), ("BLEU", "Score"), ("Long Short-Term Memory", "M"), ("Recurrent Neural Network", "M")]


def test_graph_endpoints_and_isolated(spark):
    e = entities(spark, ("BERT", "Model"), ("Orphan", "Model"), ("1.", "X"))
    r = spark.createDataFrame([(0, "bert", "", "uses", "Attention", "Idea", None), (1, "BERT", "", None, "7", "", None), (2, "BERT", "", "Is A", "BERT", "", None)],
                              "pos long, head string, head_type string, relation string, tail string, tail_type string, evidence string")
    nodes, edges = graph.build_graph(e, r)
    assert sorted(x.id for x in graph.drop_isolated(nodes, edges).collect()) == ["Attention", "BERT"]
    assert sorted((x.src, x.dst, x.type) for x in edges.collect()) == [("BERT", "Attention", "USES"), ("BERT", "BERT", "IS_A")]


def test_khop_reaches_two_steps(spark):
    e = spark.createDataFrame([("A1", "B", "R"), ("B", "C", "R"), ("C", "D", "R"), ("D", "D", "SELF")], "src string, dst string, type string")
    s = spark.createDataFrame([(1, "a1")], "query_id long, term string")
    assert [(r.head, r.tail) for r in graph.khop_facts(e, s, 2).orderBy("fact_no").collect()] == [("A1", "B"), ("B", "C")]


def test_small_blocks_are_cut_in_the_task(spark, monkeypatch):
    """Rows are copied once for each block of the other side; small blocks must not multiply them. Copies and ties go by id."""
    rnd = np.random.default_rng(4)
    m = np.round(rnd.normal(size=(300, 3)), 1)
    m[150:] = m[:150]
    vec = spark.createDataFrame([(i, r.tolist(), "ab"[i % 2]) for i, r in enumerate(m)], "chunk_id long, embedding array<double>, chunk_type string")
    q = vec.select(F.col("chunk_id").alias("query_id"), "embedding", F.when(F.col("chunk_id") % 3 == 0, "a").alias("want"))
    dealt, blocks = [], vectors._blocks
    monkeypatch.setattr(vectors, "_blocks", lambda *a: dealt.append(blocks(*a)) or dealt[-1])
    got = vectors.knn(q, vec, 7, question_mb=0.0005, vector_mb=0.001)
    assert [n for n, _ in dealt] == [1, 1]
    want = set()
    for i in range(300):
        ids = [j for j in np.lexsort((np.arange(300), -np.round(m @ m[i], 9))) if i % 3 or j % 2 == 0]
        want |= {(i, int(j), rank) for rank, j in enumerate(ids[:7], 1)}
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in got.collect()} == want


def test_boosted_scores_go_zone_by_zone(spark, monkeypatch):
    """At most k rows a question and zone; no pair is a row unless its chunk id repeats or isn't stored."""
    monkeypatch.setattr(postings, "ZONE_CHUNKS", 15)
    monkeypatch.setattr(postings, "QUESTIONS", 4)
    rnd = random.Random(5)
    words = ["ab", "abc", "xab", "of", "the", "zz9", "12", "3", "tab"]
    rows = [(f"c{i}", " ".join(rnd.choice(words) + rnd.choice(["", "", "1"]) for _ in range(rnd.randint(0, 8))), "text", rnd.choice([None, 1, 3, 12, 77]), None) for i in range(90)]
    schema = "chunk_id string, text string, chunk_type string, number long, content_priority double"
    asked = [(1, "ab the 12"), (2, "abc 3"), (3, "3"), (4, ""), (5, None), (6, "of of ab"), (6, "of of ab"), (None, "zz9 xab"), (None, "tab 77"), (7, "77 nothing")]
    q = spark.createDataFrame(asked, "query_id long, query string")

    def both(rows, stored):
        c = spark.createDataFrame(rows, schema)
        ix = lexical.lexical_index(spark.createDataFrame(stored, schema).repartition(2))
        terms = lexical.query_terms(q)
        lead = terms.select("query_id", F.col("term").alias("needle")).distinct()
        inside = lexical.containing_terms(lead.select(F.col("needle").alias("term")).distinct(), ix.terms.select("term"))
        runs = q.select("query_id", F.explode(F.regexp_extract_all("query", F.lit(r"(\d+)"), F.lit(1))).alias("r"))
        digits = runs.select("query_id", F.explode(lexical._digit_parts(F.col("r"))).alias("digits")).distinct()
        pairs = lexical._boosted_pairs(q, lead, inside, digits, c, F.lit(0.0), ix)
        want = lexical.ranked(pairs.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), 6)
        key = lambda df: sorted(((r.query_id or 0, r["rank"], r.chunk_id, round(r.score, 7)) for r in df.collect()), key=repr)
        return key(lexical.bm25_boosted(q, c, ix, 6)), key(want)

    more = rows + [rows[3], (None, *rows[4][1:]), ("not stored", "ab", "text", 3, None)]
    got, want = both(more, more[:-1])
    assert got == want and len(got) > 30
    got, want = both(rows, rows)
    monkeypatch.setattr(lexical, "bm25_scores", None)
    c = spark.createDataFrame(rows, schema)
    assert got == want and lexical.bm25_boosted(q, c, lexical.lexical_index(c), 6).count() == len(got)
