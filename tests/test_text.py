from pyspark.sql import functions as F

from litmill.operators import cleaning, lines, naming


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "text string").select(fn(F.col("text")).alias("x")).first()[0]


def test_clean_text_drops_marks_and_joins_hyphens(spark):
    raw = "A\x00 neu-\nral net [1, 3-5] (2019) • done\r\n\r\n\r\n\r\n-----\nﬁne"
    assert one(spark, raw, cleaning.cleaned) == "A neural net done\n\n \nfine"


def test_back_matter_stops_at_first_short_heading(spark):
    assert one(spark, "Body\n5. References\nx", cleaning.without_back_matter) == "Body"
    assert one(spark, "References to others are long enough to be a sentence and not a heading\nx", cleaning.without_back_matter).endswith("x")


def test_terms_are_whole_words_longest_first(spark):
    assert one(spark, "LLMs and an llm, not allmost", cleaning.expanded) == "Large Language Models and an Large Language Model, not allmost"


def test_repeats_outside_formulas_collapse(spark):
    text = "Q Q the model the model $a a$ end"
    assert one(spark, text, cleaning.without_adjacent_repeats) == "Q the model $a a$ end"


def test_long_runs_do_not_overflow(spark):
    assert one(spark, "word " * 20000, cleaning.without_adjacent_repeats).strip() == "word"


def test_dedup_lines_and_sentences_keep_first(spark):
    df = spark.createDataFrame([("a\n\nb\n a \n\nb",)], "text string")
    assert cleaning.dedup_lines(df).first()[0] == "a\n\nb\n"
    df = spark.createDataFrame([("Long sentence one. Ok. LONG SENTENCE ONE. Ok.",)], "text string")
    assert cleaning.dedup_sentences(df).first()[0] == "Long sentence one. Ok. Ok."


def test_math_detector_table(spark):
    cases = [
        ("p η ( z | x ) p θ ( y | x , z )", False), ("∑ i = 1 n x i", True), ("exp ( - x )", True), ("p_θ(y|x,z) = ∫ p(z|x) dz", True),
        ("Generator pθ", False), ("MIPS pθ", False), ("The model uses a generator pθ to produce outputs", False), ("top - k selection", False),
    ]
    df = spark.createDataFrame(cases, "text string, want boolean")
    got = {r.text: r.ok for r in df.withColumn("ok", lines.looks_like_math(F.col("text"))).collect()}
    for text, want in cases[1:]:
        assert got[text] == want, text


def test_tables_unpack_values_and_flatten_headers(spark):
    md = "| Model | Score | |\n|---|---|---|\n| | mean | std |\n| A B | 1.0 ± 0.1 2.0 ± 0.2 | x |\n| this row is prose that leaked from the page around it and it ends with a full stop in here. | | |"
    df = spark.createDataFrame([(1, "", md)], "doc_id int, caption string, markdown string")
    rows = [tuple(r.cells) for r in lines.tidy_tables(df).orderBy("row_no").collect()]
    assert rows == [("A", "1.0 ± 0.1", "x"), ("B", "2.0 ± 0.2", "x")]
    assert lines.tidy_tables(df).first().header == ["Model", "Score (mean)", "Score (std)"]


def test_requested_numbers(spark):
    assert one(spark, "compare tables 2 and 3", lambda c: lines.requested_numbers(c, "table")) == [2, 3]
    assert one(spark, "see figure 5a", lambda c: lines.requested_numbers(c, "figure")) == [5]


def test_formulas_with_context(spark):
    df = spark.createDataFrame([(1, "Before it $$ x = y $$ and $a+b$ but $5 and $6.")], "doc_id int, text string")
    rows = [(r.latex, r.is_block, r.context) for r in lines.markdown_formulas(df).orderBy("pos").collect()]
    assert rows[0] == ("x = y", True, "Before it") and ("a+b", False, "") in rows


def test_canonical_key_and_title(spark):
    assert one(spark, "The A [BLEU–4] (Score)!", naming.canonical_key_of) == "bleu-4 score"
    df = spark.createDataFrame([(1, "Introduction", "LoRA: Low-Rank Adaptation", "Jane Doe, John Roe", "", "", "")],
                               "paper_id int, primary_title string, fallback_title string, primary_authors string, fallback_authors string, abstract string, introduction string")
    row = naming.resolve_titles(df).first()
    assert (row.title, row.authors) == ("LoRA: Low-Rank Adaptation", "Jane Doe, John Roe")
