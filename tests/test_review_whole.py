"""Evidence is judged on whole sentences; the short form is only for show."""

from pyspark.sql import functions as F

from litmill.operators import review

START = "we describe in this part of the text at some length and with many plain words how all of the work was done over the years by all those who took part in it and "


def papers(spark, **sections):
    return spark.createDataFrame([(1, *sections.values())], "paper_id long, " + ", ".join(f"{s} string" for s in sections))


def test_what_stands_late_in_a_sentence_counts(spark):
    assert len(START) > 157
    late = START + "the accuracy of 91.5% on the dataset outperforms the baseline"
    got = review.select_evidence(papers(spark, results=f"Some benchmark was read here once. {late}. Other words are here too."), 1, ["strengths"]).first()
    assert got.evidence == [late]


def test_long_sentences_with_an_equal_start_are_two(spark):
    a, b = START + "the dataset of one group", START + "the benchmark of another"
    df = spark.createDataFrame([([a, b, a],)], "e array<string>")
    assert df.select(review.clean_evidence(F.col("e")).alias("x")).first().x == [a, b]


def test_the_short_form_is_asked_for_and_comes_last(spark):
    a, b = START + "the dataset of one group", START + "the benchmark of another"
    df = spark.createDataFrame([([a, b],)], "e array<string>")
    got = df.select(review.clean_evidence(F.col("e"), trim=True).alias("x")).first().x
    assert len(got) == 2 and all(len(x) <= 160 and x.endswith("…") for x in got)


def test_a_figure_is_ranked_by_its_whole_text(spark):
    """The label alone is shown; keywords in the context count."""
    figures = F.array(F.struct(F.lit("score of the whole").alias("label"), F.lit("7").alias("value"), F.lit("same baseline as before").alias("context"), F.lit("Results").alias("section")))
    p = papers(spark, results="").withColumn("key_figures", figures)
    assert review.select_evidence(p, 3, ["fairness_of_comparison"]).first().evidence == ["score of the whole: 7"]
