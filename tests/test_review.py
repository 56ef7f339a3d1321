"""Rules of the critical review, one case for each branch."""

import pytest

from litmill.functions import review_values as rv
from litmill.operators import review

SECTIONS = "paper_id long, abstract string, introduction string, methodology string, results string, conclusion string, limitations string, future_work string"
ASSESSED = "paper_id long, dimension string, verdict string, rationale string, evidence array<string>, confidence string"
PROFILE = ASSESSED
NEE = rv.NOT_ENOUGH
HYPER = "We train with learning rate 0.1 and batch size 32."
DATA = "The dataset has a test split."
SETUP = "The training setup is given in full."
RELEASE = "All code is on github."


def normalized(spark, dimension, verdict, evidence, confidence="High", rationale="As the text says.", **sections):
    paper = [(1, *[sections.get(s, "") for s in rv.PAPER_SECTIONS])]
    rows = spark.createDataFrame([(1, dimension, verdict, rationale, evidence, confidence)], ASSESSED)
    none = spark.createDataFrame([], "paper_id long, dimension string, evidence array<string>")
    out = review.normalize_assessments(rows, none, spark.createDataFrame(paper, SECTIONS)).collect()
    assert len(out) == 1
    return out[0]


@pytest.mark.parametrize(
    "text, verdict, expected",
    [
        ("We introduce a new framework.", "", 0),
        ("We introduce a new framework with quantization.", "", 4),
        ("We introduce a new framework based on others.", "", None),
        ("We introduce a new framework based on others.", "Foundational contribution", 0),
        ("It relies on quantization and adaptation.", "", 1),
        ("It is an adaptation.", "", 2),
        ("It is ready for production and is a variant.", "", 3),
        ("It is a study.", "Foundational contribution", None),
    ],
)
def test_novelty_is_classified_anew(spark, text, verdict, expected):
    got = normalized(spark, "novelty", verdict, ["novel approach, accuracy 91% on the benchmark"], introduction=text)
    assert got.verdict == (NEE if expected is None else rv.VERDICTS["novelty"][expected])
    assert got.confidence == "Low"  # one concrete item


def test_reproducibility_needs_signals(spark):
    said = ["The learning rate of the optimizer is 0.1"]
    full = normalized(spark, "reproducibility", "Reasonably reproducible", said, methodology=f"{HYPER} {DATA} {SETUP} {RELEASE}")
    assert full.verdict == rv.VERDICTS["reproducibility"][0]
    assert full.rationale.startswith("Reproducibility signals present: data, hyperparameters, release, setup. Missing signals: protocol.")
    closed = normalized(spark, "reproducibility", "Reasonably reproducible", said, methodology=f"{HYPER} {DATA} {SETUP}")
    assert closed.verdict == rv.VERDICTS["reproducibility"][1] and closed.rationale.endswith(rv.RELEASE_INCOMPLETE)
    part = normalized(spark, "reproducibility", "Reasonably reproducible", said, methodology=HYPER)
    assert part.verdict == rv.VERDICTS["reproducibility"][1] and part.rationale.endswith(rv.CORE_MISSING) and part.confidence == "Low"
    none = normalized(spark, "reproducibility", "Reasonably reproducible", ["does not mention hyperparameters"], methodology="Nothing else.")
    assert none.verdict == NEE and none.rationale == rv.MISSING_EVIDENCE["reproducibility"] and none.evidence == []


def test_fairness_needs_baselines_and_metrics(spark):
    said = ["It beats the baseline in accuracy"]
    fair = normalized(spark, "fairness_of_comparison", "", said, results="Systems are compared to others. The same budget is used. Accuracy is given.")
    assert fair.verdict == rv.VERDICTS["fairness_of_comparison"][0]
    partly = normalized(spark, "fairness_of_comparison", "", said, results="Systems are compared to others.")
    assert partly.verdict == rv.VERDICTS["fairness_of_comparison"][1] and partly.rationale.endswith(rv.CONTROLS_UNCLEAR)
    none = normalized(spark, "fairness_of_comparison", "", ["It beats the baseline"])
    assert none.verdict == NEE and none.rationale == rv.MISSING_EVIDENCE["fairness_of_comparison"]


def test_deployment_words_constrain_applicability(spark):
    said = ["It can be used in practical tasks with latency 5 ms"]
    got = normalized(spark, "applicability", "Applicability is unclear from the text", said, results="Throughput is high.")
    assert got.verdict == rv.VERDICTS["applicability"][1] and "(latency, throughput)" in got.rationale
    one = normalized(spark, "applicability", "Applicability is unclear from the text", said)
    assert one.verdict == rv.VERDICTS["applicability"][2]


def test_weaknesses_threats_and_assumptions_need_words(spark):
    for d, word in (("weaknesses", "The scope is narrow."), ("threats_to_validity", "The scope is narrow."), ("assumptions", "We assume that it holds.")):
        plain = ["The dataset is named here"] if d == "assumptions" else ["It was done in one way, for one language alone"]
        verdict = rv.VERDICTS[d][1] if d == "assumptions" else ""
        with_word = normalized(spark, d, rv.VERDICTS[d][1], ["limited to one dataset, as we assume"], methodology=word)
        assert with_word.verdict == rv.VERDICTS[d][1]
        assert normalized(spark, d, verdict, plain).verdict == NEE


def items(n):
    return [f"accuracy {k}1.5% on benchmark {k}" for k in range(1, n + 1)]


CASES = [
    ("weaknesses", ("x", items(2), "Low"), (NEE, [], "Low"), 3),
    ("threats_to_validity", ("x", items(2), "Low"), ("x", [], "Low"), 3),
    ("strengths", ("x", items(2), "Low"), ("y", [], "Low"), 0),
    ("strengths", ("x", [], "Low"), ("y", items(2), "Low"), 1),
    ("applicability", ("x", [], "Low"), (NEE, [], "Low"), 0),
    ("applicability", (NEE, [], "Low"), ("x", [], "Low"), 1),
    ("applicability", (NEE, [], "Low"), (NEE, [], "Low"), 3),
    ("applicability", ("x", items(3), "Low"), ("x", [], "Low"), 0),
    ("applicability", ("x", [], "Low"), ("y", items(3), "Low"), 3),
    ("applicability", ("x", [], "Low"), ("x", items(3), "Low"), 2),
    ("applicability", ("x", items(1), "Low"), ("y", [], "Low"), 2),
    ("applicability", ("x", items(2), "High"), ("x", [], "Low"), 0),
    ("applicability", ("x", [], "Low"), ("x", items(1), "High"), 1),
    ("applicability", ("x", [], "Medium"), ("x", [], "Low"), 2),
    ("applicability", ("x", items(3), "Low"), ("y", [], "Medium"), 0),
    ("novelty", ("Foundational contribution", [], "Low"), ("Efficiency innovation", [], "Low"), 0),
    ("novelty", ("Practical", [], "Low"), ("Foundational contribution", [], "Low"), 1),
    ("novelty", ("Practical", [], "Low"), ("Efficiency innovation", [], "Low"), 2),
    ("novelty", ("Practical", [], "Low"), (NEE, [], "Low"), 3),
    ("novelty", (NEE, [], "Low"), ("Foundational contribution", [], "Low"), 1),
    ("novelty", ("Foundational contribution", [], "Low"), ("Foundational contribution", [], "Low"), 5),
    ("novelty", ("Foundational contribution", [], "Low"), ("Foundational contribution", ["an adaptation"], "Low"), 0),
]


def test_decision_table(spark):
    """Pair k holds case k: papers 2k and 2k + 1."""
    rows = [(2 * k + i, d, side[0], "", side[1], side[2]) for k, (d, a, b, _) in enumerate(CASES) for i, side in enumerate((a, b))]
    pairs = spark.createDataFrame([(k, 2 * k, 2 * k + 1) for k in range(len(CASES))], "pair_id long, paper_a long, paper_b long")
    got = {r.pair_id: r.judgement for r in review.compare_profiles(pairs, spark.createDataFrame(rows, PROFILE)).collect()}
    assert got == {k: rv.PAIRWISE[d][entry] for k, (d, _, _, entry) in enumerate(CASES)}


def test_written_evidence_that_a_profile_holds_goes(spark):
    held, fresh, fifth = "accuracy 91.5% on the benchmark", "latency of 20 ms on the benchmark", "perplexity 7 on the dataset"
    rows = [(1, "strengths", "x", "", [held], "Low"), (2, "strengths", "y", "", [], "Low")]
    pairs = spark.createDataFrame([(1, 1, 2)], "pair_id long, paper_a long, paper_b long")
    raw = [(1, 0, "strengths", rv.PAIRWISE_FALLBACK, "r", [f"- {held}.", fresh, held, held, fifth])]
    raw = spark.createDataFrame(raw, "pair_id long, pos int, dimension string, judgement string, rationale string, evidence array<string>")
    got = review.normalize_pairwise(raw, pairs, spark.createDataFrame(rows, PROFILE)).first()
    assert got.is_local and got.evidence == [fresh, f"Paper A: {held}"]
