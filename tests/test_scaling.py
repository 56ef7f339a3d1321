"""Intermediate rows stay near the results, whatever the texts share."""

import random

from pyspark.sql import functions as F

from litmill.operators import queries


def test_close_sets_are_few_and_miss_none(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    sets = [rnd.sample(words, rnd.randint(3, 24)) for _ in range(150)] + [[], ["w1"]]
    sets += [s[:-1] + ["odd"] for s in sets[:20]]
    rows = spark.createDataFrame(list(enumerate(sets)), "id long, w array<string>")
    got = [(r.a, r.b) for r in queries.close_sets(rows, rows, 0.5).collect()]
    want = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if x and y and len({*x} & {*y}) > 0.5 * max(len(x), len(y))}
    assert want <= set(got) and len(got) == len(set(got))
    assert len(got) < len(want) + 0.1 * len(sets) ** 2


def test_frequent_words_are_dealt_to_shards(spark, monkeypatch):
    monkeypatch.setattr(queries, "SHARE", 5)
    rows = spark.createDataFrame([(i, ["all", f"x{i % 9}"]) for i in range(40)], "id long, w array<string>")
    got = {(r.a, r.b) for r in queries.close_sets(rows, rows, 0.5).collect()}
    assert {(i, j) for i in range(40) for j in range(40) if i % 9 == j % 9} <= got


def test_similar_queries_of_copies_and_nulls(spark):
    h = spark.createDataFrame([("a b c", "one", 0.5), ("a b c", "two", 0.9), ("a b c d", "three", 0.5), (None, "n", 1.0)], "past_query string, expansion string, score double")
    q = spark.createDataFrame([(1, "a b c"), (2, "A b c"), (3, "a b c"), (4, None), (5, "")], "query_id long, query string")
    got = sorted((r.query_id, r.past_query, r.expansion, round(r.similarity, 6)) for r in queries.similar_queries(q, h).collect())
    assert got == [x for i in (1, 2, 3) for x in ((i, "a b c", "two", 1.0), (i, "a b c d", "three", 0.75))]
    assert queries.similar_queries(q, h, keep=1).agg(F.count("*")).first()[0] == 3


def test_word_points_equal_the_column_rules(spark):
    """Points counted a batch at a time equal the rules written out for one sentence; null rows and empty lists come through."""
    from litmill.functions import review_values as rv
    from litmill.operators import review

    words = sorted({w for ws in [*rv.KEYWORDS.values(), *rv.REQUIRED.values(), rv.SETUP_WORDS, rv.RESULT_WORDS] for w in ws})
    rnd = random.Random(3)
    texts = [" ".join(rnd.sample(words, n)) + " the 12% ones" * (n % 2) for n in (0, 1, 2, 3, 5) for _ in range(12)] + ["", "Só é", "x" * 50]

    def want(s: str, d: str) -> int:
        import re

        low, has = s.lower(), lambda ws: any(w in s.lower() for w in ws)
        java = lambda p: re.search(p, s) is not None
        n = 4 * sum(c in "0123456789" for c in s) + 3 * sum(w in low for w in rv.KEYWORDS[d]) + 2 * ("%" in s) + (len(s) > 40)
        n += 2 * has(["not ", "only ", "missing", "limited", "unclear"]) - 6 * (d in rv.REQUIRED and not has(rv.REQUIRED.get(d, [])))
        n -= 6 * (d in ("threats_to_validity", "applicability") and java(rv.ARCHITECTURE_NOISE)) + 6 * (d == "applicability" and java(rv.APPLICABILITY_NOISE))
        if d == "reproducibility" and not has(rv.SETUP_WORDS):
            n -= 12 * java(rv.RESULT_NOISE) + 15 * has(rv.RESULT_WORDS)
        return n

    rows = spark.createDataFrame(list(enumerate(texts)), "pos int, sentence string")
    got = {(r.pos, r.dimension): r.score for r in review.score_evidence(rows).collect()}
    assert got == {(i, d): want(s, d) for i, s in enumerate(texts) for d in rv.DIMENSIONS}
    lists = spark.createDataFrame([(0, None), (1, []), (2, ["novel", None]), (3, ["only f1"])], "i int, w array<string>")
    sizes = {r.i: r.n for r in lists.select("i", F.size(review._points(F.col("w"))).alias("n")).collect()}
    assert (sizes[1], sizes[2], sizes[3]) == (0, 2, 1)
