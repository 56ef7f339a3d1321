"""The Pitman-Yor model: every word before is a context, exact pair counts, a distribution, scores as its tables say, whatever the partitions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from litmill.llm import pitman_yor as py


def table(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


def words_of(text):
    return [*re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower()), b""]


def plain(rows, min_count):
    """(number of each common word, counts of words, counts of pairs) of the texts."""
    count = Counter(w for t in rows for w in words_of(t))
    common = sorted((w for w, n in count.items() if n >= min_count), key=lambda w: (-count[w], w))
    number = {w: k for k, w in enumerate(common, 1)}
    pairs = Counter()
    for t in rows:
        ids = [number.get(w, py.RARE) for w in [b"", *words_of(t)]]
        pairs.update(zip(ids, ids[1:]))
    return number, count, pairs


def test_every_word_is_a_context(spark, tmp_path):
    """60 words, each followed by its own; a text with the pairs of another word is less probable."""
    rows = [(k * 20 + j, f"a{k} b{k}") for k in range(60) for j in range(20)]
    rows += [(5000 + k, f"a{k} b{k}") for k in range(60)] + [(6000 + k, f"a{k} b{(k + 7) % 60}") for k in range(60)]
    got = {r.doc_id: r.score for r in py.pitman_yor_scores(table(spark, tmp_path, rows), F.col("doc_id") >= 5000).collect()}
    assert all(got[5000 + k] > got[6000 + k] + 1 for k in range(60))


def test_scores_do_not_depend_on_partitions(spark, docs):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in (4, 7):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            rows = py.pitman_yor_scores(docs.repartition(n), F.coalesce(F.col("doc_id") % 3 == 1, F.lit(False)), 2).collect()
            found.append(Counter((r.doc_id, r.n_tokens, round(r.base_score, 9), round(r.score, 9)) for r in rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_pairs_distribution_and_scores(spark, docs, rows, monkeypatch):
    """Pairs are counted exactly; after each word the probabilities of all dishes sum to 1; scores are those of the tables."""
    monkeypatch.setattr(py, "BLOCK_TOKENS", 5000)
    trained = [r[1] for r in rows if r[0] is not None and r[0] < 250]
    blocks, asks, voc, model, shards = py.learnt(docs.select("doc_id", "text", F.coalesce(F.col("doc_id") < 250, F.lit(False)).alias("train")), 2)
    assert blocks.count() > 2
    number, count, pairs = plain(trained, 2)
    shard = model.pairs.collect()
    lone = np.concatenate([py.unpacked(pa.array([r.lone]), py.LONE) for r in shard])
    more = np.concatenate([py.unpacked(pa.array([r.busy]), py.PAIR) for r in shard])
    assert {(u, w): 1 for u, w in lone.tolist()} | {(u, w): n for u, w, n in more.tolist()} == pairs and len(lone) + len(more) == len(pairs)
    assert (voc.n_tokens, voc.n_words, voc.size) == (sum(count.values()), len(count), len(number) + 1)
    busy = {(r.u, r.w): r for r in model.busy.collect()}
    assert set(busy) == {p for p, n in pairs.items() if n > 1}
    assert all(model.kept <= r.sum <= model.kept * r.n and 1 <= r.t <= r.n for r in busy.values())
    words = {r.id: r for r in model.words.collect()}
    assert set(words) == set(range(voc.size))
    own = {p: pairs[p] - model.own * (busy[p].sum / model.kept if p in busy else 1) for p in pairs}
    kept = defaultdict(float)
    for (u, _), x in own.items():
        kept[u] += x
    for k in range(model.kept):
        assert sum(r.shared[k] for r in words.values()) == pytest.approx(1, abs=1e-9)
    for u, r in words.items():
        assert kept[u] / (py.STRENGTH + r.c) + np.mean(r.back) == pytest.approx(1, abs=1e-9)
    rare_n, rare_v = sum(n for w, n in count.items() if w not in number), len(count) - len(number)
    want = Counter()
    for r in rows:
        s, u = 0.0, number[b""]
        for w in words_of(r[1]):
            i = number.get(w, py.RARE)
            p = own.get((u, i), 0.0) / (py.STRENGTH + words[u].c) + np.mean([b * x for b, x in zip(words[u].back, words[i].shared)])
            s += np.log10(p if i else p * (count[w] + 0.5) / (rare_n + 0.5 * (rare_v + 1)))
            u = i
        want[r[0], len(words_of(r[1])), round(s, 1)] += 1
    got = Counter((r.doc_id, r.n_tokens, round(r.score, 1)) for r in py.score(blocks, asks, voc, model, shards).collect())
    assert sum((want - got).values()) <= 1  # rounding


def slowly(customers, new, discount, r):
    t = 1
    for at in range(1, customers):
        t += r.random() < new / (new + at - discount * t)
    return t


@pytest.mark.parametrize("customers", [3, 60, 300, 5000])
def test_tables_follow_the_restaurant(customers):
    """The mean number of tables is that of customers seated one after another, also where later ones come in groups."""
    n = 4000
    t = py.seated(np.full(n, customers), lambda k, t: np.full(len(k), 0.7), 0.5, np.arange(n), 0)
    r = random.Random(2)
    slow = [slowly(customers, 0.7, 0.5, r) for _ in range(400)]
    assert t.mean() == pytest.approx(np.mean(slow), rel=0.06)
    alone = py.seated(np.full(n, customers), lambda k, t: np.full(len(k), 0.7), 0.5, np.arange(n), 0, steps=10**9)
    assert t.mean() == pytest.approx(alone.mean(), rel=0.03)
    assert py.seated(np.array([0, 1]), lambda k, t: np.ones(len(k)), 0.5, np.arange(2), 0).tolist() == [0, 1]


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    got = py.pitman_yor_scores(d, F.lit(True)).collect()
    assert [(r.score, r.base_score, r.n_known, r.train_tokens) for r in got] == [(0, 0, 0, 0)] * 2
