"""Plug-in points: built once per task, fed in batches, results in the operators' shape."""

import numpy as np
from litmill.operators import fusion, vectors
from litmill.sources import model_output


def test_embed_with_scales_and_batches(spark):
    def make():
        def model(texts):
            assert len(texts) <= 3
            return np.array([[len(t), 0.0 if t else 0.0, 2.0 * len(t)] for t in texts])

        return model

    df = spark.createDataFrame([(i, "x" * i) for i in range(10)], "id long, text string").repartition(2)
    got = {r.id: r.embedding for r in vectors.embed_with(df, make, batch=3).collect()}
    assert got[0] == [0, 0, 0] and len(got) == 10
    assert all(abs(sum(x * x for x in got[i]) - 1) < 1e-6 and abs(got[i][2] - 2 * got[i][0]) < 1e-6 for i in range(1, 10))


def test_rerank_with_orders_by_score_then_id(spark):
    q = spark.createDataFrame([(1, "ab"), (2, "abcd")], "query_id long, query string")
    c = spark.createDataFrame([(1, "c", "xx"), (1, "a", "yy"), (1, "b", "xyz"), (2, "z", "")], "query_id long, id string, text string")
    make = lambda: lambda qs, ts: [float(len(t) - len(q)) for q, t in zip(qs, ts)]
    rows = fusion.rerank_with(q, c, make, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.score, r["rank"]) for r in rows] == [(1, "b", 1.0, 1), (1, "a", 0.0, 2), (2, "z", -4.0, 1)]


def test_extract_with_feeds_the_parsers(spark):
    df = spark.createDataFrame([(1, "Ann"), (2, "broken"), (3, 'quo"te')], "chunk_id long, text string")

    def make():
        import json

        return lambda t: "no json" if t == "broken" else "```json\n" + json.dumps([{"name": t, "type": ""}]) + "\n```"

    rows = model_output.parse_entities(model_output.extract_with(df, make)).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.name, r.type) for r in rows] == [(1, "Ann", "Concept"), (3, 'quo"te', "Concept")]
