"""No operator stops at a number of characters, terms or rows."""

import pytest
from pyspark.sql import functions as F

from litmill.operators import chunking, fusion, lexical, lines, metrics, papers, queries, validation
from litmill.session import ensure_checkpoint_dir
from litmill.sources import sinks

WORDS = [f"w{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{chr(97 + i // 676)}q" for i in range(700)]


def one(spark, text, key="doc_id"):
    return spark.createDataFrame([(1, text)], f"{key} long, text string")


def test_character_chunkers_reach_the_end(spark):
    text = " ".join(f"sentence number {i} ends here." for i in range(12_000)) + " LASTWORD"
    for made in (
        chunking.sliding_chunks(one(spark, text)),
        chunking.boundary_chunks(one(spark, text)),
        chunking.fallback_chunks(one(spark, text)),
        chunking.build_chunks(one(spark, text), "sliding"),
        chunking.canonical_sections(one(spark, text)).select(F.col("introduction").alias("text")),
    ):
        assert made.where(F.col("text").contains("LASTWORD")).count() >= 1


def test_boundary_chunks_with_early_breaks_reach_the_end(spark):
    text = "".join("x" * 1010 + "\n\n" + "y" * 5 for _ in range(60)) + "END"
    rows = chunking.boundary_chunks(one(spark, text), 2000, 200).orderBy("chunk_no").collect()
    assert rows[-1].stop == len(text) and all(a.stop >= b.start for a, b in zip(rows, rows[1:]))


def test_all_terms_of_a_question_count(spark):
    q = spark.createDataFrame([(1, 1, " ".join(WORDS[:130]))], "query_id long, doc_id long, query string")
    assert queries.seed_terms(q).count() == 130
    assert len(q.select(lexical.key_terms_of(F.col("query")).alias("t")).first().t) == 130
    last = spark.createDataFrame([("a", 1, f"x{WORDS[129]}x", "table", 1, 1.0), ("b", 1, "zz", "table", 2, 1.0)], "chunk_id string, doc_id long, text string, chunk_type string, number long, content_priority double")
    found = {r.chunk_id: r.score for r in lexical.bm25_boosted(q, last, lexical.lexical_index(last), 2).collect()}
    assert round(found["a"] - found["b"], 6) == 0.05


def test_all_numbers_and_variables_are_checked(spark):
    answer = spark.createDataFrame([(1, " ".join(str(1000 + i) for i in range(120)))], "response_id long, text string")
    source = spark.createDataFrame([(1, " ".join(str(1000 + i) for i in range(119)))], "response_id long, text string")
    assert validation.unsupported_numbers(answer, source).first().unsupported == ["1119"]
    letters = " ".join("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    assert len(one(spark, letters).select(lines.variables_of(F.col("text")).alias("v")).first().v) == 52


def test_context_sources_and_authors_are_whole(spark):
    long = "a" * 20_000 + " END"
    c = spark.createDataFrame([(1, 1, "Vector Chunk", long)], "query_id long, rank int, source_type string, text string")
    assert fusion.build_context(c).first().context.endswith("END")
    s = spark.createDataFrame([(1, "web", 1, long, "")], "query_id long, source string, pos int, text string, url string")
    assert sinks.combine_sources(s).first().combined.endswith("END")
    p = spark.createDataFrame([(["few"], 10**30 + 0.0)] + [([f"many{i}"], 0.0) for i in range(100) for _ in range(2)], "authors array<string>, citations double")
    assert papers.author_impact(p, top=1).first().author == "few"


def test_a_label_that_is_silent_now_has_a_run(spark):
    e = spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:30'), ('b', timestamp'2024-01-01 00:00:10'), ('b', timestamp'2024-01-01 00:09:10') t(k, ts)")
    assert {(r.label, r.minutes) for r in metrics.absence_alerts(e, "k").collect()} == {("a", 8), ("b", 8)}
    later = metrics.absence_alerts(e, "k", as_of=F.expr("timestamp'2024-01-01 00:20:00'")).collect()
    assert {(r.label, r.minutes) for r in later} == {("a", 19), ("b", 8), ("b", 10)}


def test_a_cluster_must_name_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
