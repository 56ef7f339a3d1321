"""Stored postings: appended batches equal one build, skipped zones change nothing, broken batches are not read."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from litmill.functions import fixed_values as fv
from litmill.operators import lexical, postings
from pyspark.sql import functions as F


def brute(chunks, asked, k):
    """(question, chunk, score, rank) by scoring every chunk."""
    docs = {c: [t for t in re.findall(r"[a-z0-9]+", text.lower()) if len(t) > 1] for c, text in chunks}
    df = Counter(t for ts in docs.values() for t in set(ts))
    avg = max(1.0, sum(map(len, docs.values())) / len(docs))
    out = []
    for q, text in asked:
        scores = {}
        for t, qf in Counter(x for x in re.findall(r"[a-z0-9]+", text.lower()) if len(x) > 1).items():
            idf = math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5))
            for c, ts in docs.items():
                if tf := ts.count(t):
                    norm = fv.BM25_K1 * (1 - fv.BM25_B + fv.BM25_B * max(1, len(ts)) / avg)
                    scores[c] = scores.get(c, 0) + idf * qf * tf * (fv.BM25_K1 + 1) / (tf + norm)
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        out += [(q, c, round(s, 6), i) for i, (c, s) in enumerate(best, 1)]
    return sorted(out)


def corpus(n, seed=1):
    """Neighbours are about the same things: each run of 40 chunks has words of its own beside common ones."""
    r = random.Random(seed)
    own = lambda i: [f"w{i // 40}x{j}" for j in range(12)]
    common = "of the and in on with from that this".split()
    return [(i, " ".join(r.choice(own(i)) if r.random() < 0.4 else r.choice(common) for _ in range(r.randint(1, 60)))) for i in range(n)]


def found(result):
    return sorted((r.query_id, r.chunk_id, round(r.score, 6), r["rank"]) for r in result.collect())


@pytest.fixture
def small_zones(monkeypatch):
    monkeypatch.setattr(postings, "ZONE_CHUNKS", 20)


def test_batches_equal_one_build(spark, tmp_path, small_zones):
    chunks = corpus(400)
    asked = [(1, "w3x1 w3x2 the of"), (2, "W9x1, w5x5"), (3, "nothing here"), (4, "of of the that"), (5, "")]
    df = spark.createDataFrame(chunks, "chunk_id long, text string").repartition(3, "chunk_id")
    q = spark.createDataFrame(asked, "query_id long, query string")
    one = postings.PostingStore(spark, str(tmp_path / "one")).append(df)
    two = postings.PostingStore(spark, str(tmp_path / "two")).append(df.where("chunk_id < 120")).append(df.where("chunk_id >= 120"))
    want = brute(chunks, asked, 7)
    assert found(lexical.bm25(q, one, 7)) == found(lexical.bm25(q, two, 7)) == want
    rows = lambda s: sorted(map(tuple, s.postings.collect()))
    assert rows(one) == rows(two) and len(rows(one)) > 400
    assert one.stats.first() == two.stats.first() and sorted(one.terms.collect()) == sorted(two.terms.collect())


def test_zones_are_skipped(spark, tmp_path, small_zones):
    """Questions about one neighbourhood read few zones, and find what scoring all finds."""
    chunks = corpus(800)
    asked = [(i, f"w{i}x1 w{i}x2 w{i}x3 the") for i in range(20)]
    store = postings.PostingStore(spark, str(tmp_path / "s")).append(spark.createDataFrame(chunks, "chunk_id long, text string").coalesce(1))
    terms = lexical.query_terms(spark.createDataFrame(asked, "query_id long, query string"))
    search = store.search(terms, 5)
    assert found(search.results) == brute(chunks, asked, 5)
    zones = search.zones.groupBy("read").count().collect()
    n = {r.read: r["count"] for r in zones}
    assert n[False] > 4 * n[True] and n[True] >= 20


def test_types_restrict_chunks_not_statistics(spark, tmp_path, small_zones):
    chunks = corpus(100)
    df = spark.createDataFrame([(f"c{i:03d}", t, "a" if i % 3 else "b") for i, t in chunks], "chunk_id string, text string, chunk_type string")
    store = postings.PostingStore(spark, str(tmp_path / "s")).append(df)
    q = spark.createDataFrame([(1, "w1x1 w1x2 the", "b"), (2, "w1x1 w1x2 the", None)], "query_id long, query string, want string")
    every = brute([(f"c{i:03d}", t) for i, t in chunks], [(1, "w1x1 w1x2 the"), (2, "w1x1 w1x2 the")], 1000)
    typed = [r for r in every if r[0] == 1 and int(r[1][1:]) % 3 == 0]
    want = [(1, c, s, k) for k, (_, c, s, _) in enumerate(sorted(typed, key=lambda r: r[3])[:9], 1)] + [r for r in every if r[0] == 2 and r[3] <= 9]
    assert found(lexical.bm25(q, store, 9, df)) == sorted(want)


def test_a_broken_batch_is_not_read(spark, tmp_path):
    """Blocks without a row in the table of batches belong to an append that broke off."""
    store = postings.PostingStore(spark, str(tmp_path / "s")).append(spark.createDataFrame([(1, "alpha beta")], "chunk_id long, text string"))
    fails = F.udf(lambda x: 1 // 0, "string")
    broken = spark.createDataFrame([(2, "alpha alpha")], "chunk_id long, text string").withColumn("text", fails("text"))
    with pytest.raises(Exception, match="ZeroDivisionError"):
        store.append(broken)
    q = spark.createDataFrame([(1, "alpha")], "query_id long, query string")
    assert [r.chunk_id for r in lexical.bm25(q, store).collect()] == [1]
    assert store.append(spark.createDataFrame([(3, None), (4, "")], "chunk_id long, text string")).stats.first().n_chunks == 3


def test_questions_dealt_to_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "QUESTIONS", 3)
    chunks = corpus(60)
    asked = [(i, f"w0x{i % 12} w1x1 the") for i in range(30)]
    store = postings.PostingStore(spark, str(tmp_path / "s")).append(spark.createDataFrame(chunks, "chunk_id long, text string"))
    assert found(lexical.bm25(spark.createDataFrame(asked, "query_id long, query string"), store, 4)) == brute(chunks, asked, 4)


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, text string")
    store = postings.PostingStore(spark, str(tmp_path / "s")).append(none)
    q = spark.createDataFrame([(1, "alpha")], "query_id long, query string")
    assert lexical.bm25(q, store).collect() == [] and store.stats.first().n_chunks == 0
    some = lexical.lexical_index(spark.createDataFrame([(1, "alpha")], "chunk_id long, text string"))
    assert lexical.bm25(q.where("false"), some).collect() == []


def test_a_question_is_one_row_for_a_group_of_zones():
    """Three zones and 1,100 questions, more than are scored at once: what comes back holds the k best over all zones, ties included,
    and nothing that k others pass or that lies below ``least``; repeated terms count twice; wanted types hide the others."""
    r, k, avg = random.Random(4), 3, 5.0
    zones, terms = ["z0", "z1", "z2"], [f"t{i}" for i in range(6)]
    blocks = []
    for z in zones:
        for t in terms:
            at = sorted(r.sample(range(10), r.randint(1, 6)))
            blocks.append({"zone": z, "term": t, "places": at, "tfs": [r.randint(1, 2) for _ in at], "dls": [5 for _ in at], "kinds": None})
        blocks.append({"zone": z, "term": None, "places": [], "tfs": [], "dls": [], "kinds": ["ab"[p % 2] for p in range(10)]})
    kinds = {"zone": pa.string(), "term": pa.string(), "places": pa.list_(pa.int32()), "tfs": pa.list_(pa.int32()), "dls": pa.list_(pa.int32()), "kinds": pa.list_(pa.string())}
    asked = []
    for q in range(1100):
        own = [r.choice([*terms, "absent"]) for _ in range(3)]
        least = 0.9 if q % 4 == 0 else None
        asked.append({"query_id": q, "zones": r.sample(zones, r.randint(1, 3)), "least": least, "terms": own, "weights": [r.choice([0.5, 1.0]) for _ in own], "want": r.choice(["a", None])})
    sort = {"query_id": pa.int64(), "zones": pa.list_(pa.string()), "least": pa.float64(), "terms": pa.list_(pa.string()), "weights": pa.list_(pa.float64()), "want": pa.string()}
    out = postings._group_scores(pa.Table.from_pylist(blocks, pa.schema(kinds)), pa.Table.from_pylist(asked, pa.schema(sort)), k, "query_id", avg)
    got = {}
    for row in out.to_pylist():
        got.setdefault(row["query_id"], []).append((round(row["score"], 9), row["zone"], row["place"]))
    for a in asked:
        scores = Counter()
        for b in blocks:
            for t, w in zip(a["terms"], a["weights"], strict=True):
                if b["term"] == t and b["zone"] in a["zones"]:
                    for p, tf, dl in zip(b["places"], b["tfs"], b["dls"], strict=True):
                        if a["want"] in (None, "ab"[p % 2]):
                            scores[b["zone"], p] += w * postings.impact(tf, dl, avg)
        best = sorted(((round(s, 9), *at) for at, s in scores.items()), key=lambda x: (-x[0], x[1], x[2]))
        found = sorted(got.get(a["query_id"], []), key=lambda x: (-x[0], x[1], x[2]))
        floor = a["least"] or 0
        assert found[:k] == [b for b in best[:k] if b[0] >= floor]
        assert all(b[0] >= floor and b in best and (len(found) < k or b[0] == found[k - 1][0]) for b in found[k:])


def test_bounds_of_zones():
    heads = pa.table({"term": ["a", "b", "a"], "zone": ["x", "x", "y"], "most": [1.0, 2.0, 0.5], "_q": [3, 3, 3], "_g": [1, 1, 1]})
    rows = pa.table({"query_id": [7, 8, 9], "terms": [["a", "b"], ["c"], ["b", "b"]], "weights": [[1.0, 0.5], [1.0], [1.0, 1.0]]})
    found = postings._zone_bounds(heads, rows, "query_id").to_pylist()
    assert sorted((r["query_id"], r["zone"], r["bound"], r["_q"], r["_g"]) for r in found) == [(7, "x", 2.0, 3, 1), (7, "y", 0.5, 3, 1), (9, "x", 4.0, 3, 1)]
