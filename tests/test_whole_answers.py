"""Answers are judged on whole texts, against words of all lines."""

from litmill.plans import activity, review


def test_every_line_of_a_text_is_evaluated(spark, tmp_path):
    text = "\n".join(f"first{k} and last{k}" for k in range(50))
    rows = [(1, text, "en", "s", len(text)), (2, text + "\nmore words", "en", "s", len(text))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    answers, cases = activity._whole_cases(spark, str(tmp_path))
    assert {r.answer for r in answers.collect()} == {rows[0][1], rows[1][1]}
    case = cases.where("case_id = 1").first()
    assert case.expected == [f"first{k}" for k in range(50)] and case.context == [f"last{k}" for k in range(50)]
    got = activity.QUERIES["agg14_evaluate_whole_answers"](spark, str(tmp_path)).collect()
    assert len(got) == 2 and all(r.hit_rate == r.faithfulness == 1 and r.passed for r in got)


def test_late_words_of_an_abstract_are_evidence(spark, tmp_path):
    text = "some plain words stand at the start of this long line, which goes on until the accuracy of 91.5% on the dataset"
    spark.createDataFrame([(1, text, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = review.QUERIES["rev10_consistent_evidence"](spark, str(tmp_path)).collect()
    assert any("on the dataset" in r.evidence for r in got)
