"""Divergence of sources against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from litmill.llm import source_audit as sa
from pyspark.sql import functions as F

ORDER = ["lang", "source", "part", "item", "value", "rank"]


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def kept(rows, min_docs):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        count[lang, source].update(terms(text))
        docs[lang].update(set(terms(text)))
    return count, {lang: {t for t, n in docs[lang].items() if n >= min_docs} for lang in groups}, groups


def brute(rows, min_docs, top):
    count, words, groups = kept(rows, min_docs)
    out = set()
    price = lambda p, q: (p - q) * (p - q) // (p + q)
    for lang, sources in groups.items():
        v = sorted(words[lang])
        whole = Counter()
        for s in sources:
            whole.update({t: count[lang, s][t] for t in v})

        def p(c):
            n = sum(c[t] for t in v)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(v)) for t in v}

        all_, own = p(whole), {s: p(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum(price(own[s][t], own[o][t]) for t in v), o.encode()) for o in sources if o != s]
            best = [(-price(own[s][t], all_[t]), t.encode()) for t in v if count[lang, s][t] and own[s][t] > all_[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(best)[:top])):
                out |= {(lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(found, 1)}
    return out


def made(seed, sources):
    r = random.Random(seed)
    vocabulary = [r.choice(["a", "b", "É", "zz", "Q"]) + "".join(r.choices("abcé", k=r.randint(1, 2))) for _ in range(40)]
    text = lambda k: " ".join(r.choices(vocabulary, [1 + (i * k) % 7 for i in range(len(vocabulary))], k=r.randint(0, 30))) + r.choice(["", " 12 a_b-c\n", "日本 x"])
    rows = [(r.choice(["en", "de", None]), r.choice([f"s{k}", f"s{k}", "s0"]) if k else None, text(k)) for k in [r.randrange(sources) for _ in range(200)]]
    return rows + [("fr", "alone", "some words here"), ("es", "a", None), ("es", "b", "12 ??"), ("", "", ""), ("en", "no-terms", None), *rows[:9]]


@pytest.mark.parametrize("block,tile,min_docs,sources", [(8192, 32, 10, 6), (7, 2, 3, 6), (16, 3, 1, 9), (8192, 32, 1000, 4)])
def test_against_brute_force(spark, tmp_path, monkeypatch, block, tile, min_docs, sources):
    """Whole and cut into blocks of terms and tiles of sources; nulls, lone sources, groups and languages without terms."""
    monkeypatch.setattr(sa, "BLOCK", block)
    monkeypatch.setattr(sa, "TILE", tile)
    monkeypatch.setattr(sa, "HELD", 50)
    rows = made(block + tile, sources)
    clash = [(*r, 1, "t", "d", 2, 3) for r in rows]
    spark.createDataFrame(clash, "lang string, source string, text string, n int, term string, docs string, tile int, total int").repartition(3).write.parquet(str(tmp_path / "t"))
    got = sa.source_audit(spark.read.parquet(str(tmp_path / "t")), min_docs, 4).select(*ORDER).collect()
    want = brute(rows, min_docs, 4)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_joint_tables(spark, monkeypatch):
    """The cells of every table add up to the language's terms, and are the terms with these counts."""
    monkeypatch.setattr(sa, "BLOCK", 9)
    monkeypatch.setattr(sa, "TILE", 2)
    rows = made(1, 5)
    groups, found = sa.kept_counts(spark.createDataFrame(rows, "lang string, source string, text string"), 3)
    got = defaultdict(Counter)
    for r in sa.joint_tables(groups, found).collect():
        got[r.lang, r.source, r.other][r.level, r.other_level] += r.n
    count, words, sources = kept(rows, 3)
    want = {(g, s, o): Counter((count[g, s][t], count[g, o][t]) for t in words[g]) for g in sources for s in sources[g] for o in sources[g] if s < o and words[g]}
    assert got == want and len(want) > 10


def test_edges(spark, docs, rows, none):
    got = {tuple(r) for r in sa.source_audit(docs, 3, None).select(*ORDER).collect()}
    assert got == brute([(r[2], r[3], r[1]) for r in rows], 3, None) and got
    out = sa.source_audit(none)
    assert out.columns == ORDER and out.collect() == []


def test_large_counts(spark):
    d = spark.createDataFrame([(9_000_000_000_000_000_000, 9_100_000_000_000_000_000, 5)], "c long, t long, v long")
    assert d.select(sa.chance("c", "t", "v")).first()[0] == 1 + 10**9 * (9 * 10**18 + 2) // (91 * 10**17 + 10)
    p = spark.createDataFrame([(1_000_000_001, 1)], "p long, q long")
    assert p.select(sa.price(F.col("p"), F.col("q"))).first()[0] == 10**18 // 1_000_000_002
