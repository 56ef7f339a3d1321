import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("size", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("n", T.IntegerType()),
])


def edge_rows():
    """Nulls, empty and blank texts, copies, near copies, a very long text, repeated rows; columns whose names operators use."""
    r = random.Random(5)
    words = {"en": "the and of thing that is house river".split(), "de": "der und die nicht haus schön über".split()}
    rows = []
    for k in range(40):
        lang = "en" if k % 3 else "de"
        text = "\n".join(" ".join(r.choice(words[lang]) + r.choice(["", "er", "ing", "en"]) for _ in range(r.randint(4, 30))) for _ in range(r.randint(1, 5)))
        rows.append((k, text, lang, f"src{k % 4}"))
    rows += [(100 + k, rows[7][1] + (" more" if k else ""), "en", "src0") for k in range(6)]  # a group of copies and near copies
    rows += [(200, None, "en", "src1"), (201, "", None, "src1"), (202, " \t\n ", "de", None), (203, None, None, None), (204, "?! 123 --", "en", None)]
    rows += [(None, "a text without an id, and some words more", "en", "src2"), (None, None, None, "src2")]
    rows += [(210, "Same Line Here Again\n" + rows[3][1], "en", "src1"), (211, "  same line here again\t\nshort\nshort", "en", "src1"), (212, "short\n\nshort", "en", "src3")]
    long = " ".join(f"w{k % 997}x{k // 7}" for k in range(9000))
    rows += [(300, long, "en", "src3"), (301, long.upper(), "en", "src3"), (302, "é" * 5000 + "  ß", "de", "src3")]
    rows += [(5, rows[5][1], rows[5][2], rows[5][3])] * 2  # rows that repeat
    rows += [(400, "mail a.b@c-d.org, call +1 (477) 555-4197 or 12.158.146.200 and 4366 4989 4794 7848.", "en", "src0"), (401, "bob [at] mail.example.com 1.2.3.4.5.6.7.8 @@x@y.z", "en", "src0")]
    return [(i, t, l, s, len(t or ""), 0.5, "big", "yes", 1) for i, t, l, s in rows]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from litmill.session import local_session

    spark = local_session(4, "litmill-tests", "4g")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return spark


@pytest.fixture(scope="session")
def rows():
    return edge_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables")) + "/documents.parquet"
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(folder)
    return spark.read.parquet(folder)


@pytest.fixture(scope="session")
def sf_dir(docs):
    return docs.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
