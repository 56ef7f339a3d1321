"""Evidence in Arrow against the rules in plain words."""

import pyarrow as pa
from pyspark.sql import functions as F

from litmill.functions import review_values as rv
from litmill.operators import evidence as ev
from litmill.operators import review


def test_boundaries_and_case_are_those_of_the_java_patterns(spark):
    texts = ["the Dataset.", "ädataset", "dataset2", "dataset́", "Benchmark", "ſcore 5", "5 score", "²dataset", "no_code dataset_", "not evaluat", "top K 5 toKen"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    named = F.col("t").rlike(rv.SPECIFIC) | (F.col("t").rlike(r"\d") & F.col("t").rlike(rv.SPECIFIC_UNIT))
    want = [r.x for r in df.orderBy("i").select(named.alias("x")).collect()]
    assert ev.specific(pa.array(texts)).tolist() == want


def test_sentences_are_those_of_the_column_rules(spark):
    texts = ["One. Two!  Three?\tFour", None, "a\r\nb .  c\x0bd", "", "Not found", "x. y. . z", " . "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = [s for r in df.orderBy("i").select(review.split_sentences(F.col("t")).alias("s")).collect() for s in r.s]
    assert ev.split_texts(pa.array(texts, pa.string()))[0].to_pylist() == want


def test_no_list_stays_none_and_parts_of_a_batch_are_joined(spark, monkeypatch):
    rows = [None, [], [None, "accuracy 91 on the dataset"], ["accuracy 91 on the dataset", "the dataset has 91 in accuracy"]]
    want = [None, [], ["accuracy 91 on the dataset"], ["accuracy 91 on the dataset"]]
    monkeypatch.setattr(ev, "PART_BYTES", 1)
    lists = pa.array(rows, pa.list_(pa.string()))
    assert [x for (part,) in ev._parts([lists]) for x in ev._clean(part, 5).to_pylist()] == want
    df = spark.createDataFrame([(x,) for x in rows], "e array<string>")
    assert [r.x for r in df.select(review.specific_count(F.col("e")).alias("x")).collect()] == [None, 0, 1, 2]


def test_words_are_found_where_paper_and_assessment_meet(spark):
    """The paper's text stays in its row: only its start and last sentence go to the assessment."""
    papers = spark.createDataFrame([(1, "model of the text. " + "word " * 500, "")], "paper_id long, abstract string, introduction string")
    said = spark.createDataFrame(
        [(1, "novelty", "foundational", "We propose", ["accuracy 91% on the benchmark is new"], "Low")],
        "paper_id long, dimension string, verdict string, rationale string, evidence array<string>, confidence string",
    )
    none = spark.createDataFrame([], "paper_id long, dimension string, evidence array<string>")
    got = review.normalize_assessments(said, none, papers)
    assert got.first().verdict == rv.VERDICTS["novelty"][0]  # "new" and "model"
    marks = review._scan_marks(papers)
    assert marks.agg(F.max(F.length("_head"))).first()[0] <= ev.HEAD
    assert {r.dimension for r in marks.collect()} == set(rv.DIMENSIONS) - {"strengths"}


def test_a_profile_is_weighed_once_for_all_its_pairs(spark):
    profiles = spark.createDataFrame([(i, "strengths", "v", "r", ["accuracy 5% on the dataset", "b", "c"], "High") for i in (1, 2)], "paper_id long, dimension string, verdict string, rationale string, evidence array<string>, confidence string")
    pairs = spark.createDataFrame([(1, 1, 2)], "pair_id long, paper_a long, paper_b long")
    row = review._paired(pairs, profiles, 2).first()
    assert row.sa == row.sb == 6 and row.a.evidence == ["accuracy 5% on the dataset", "b"] and "rationale" not in row.a.asDict()
