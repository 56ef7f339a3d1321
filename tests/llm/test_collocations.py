"""Phrase mining against plain Python."""

import random
import re
from collections import Counter

import pytest
from litmill.llm import collocations as co


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_count, max_words, share, top):
    """rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, max_words + 1):
                f.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    out = {}
    candidates = {g: a for g, a in f.items() if len(g) > 2 and a >= min_count}
    for g, a in candidates.items():
        lang, words = g[0], g[1:]
        if any(
            h[0] == lang and len(h) > len(g) and 100 * b >= share * a and any(h[i : i + len(words)] == words for i in range(1, len(h)))
            for h, b in candidates.items()
        ):
            continue
        cuts = [(f[lang, *words[:k]], f[lang, *words[k:]]) for k in range(1, len(words))]
        score, _, l, r = min((1_000_000 * a * a // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return {
        (lang, k, p.decode(), -a, l, r, n[lang], -s)
        for lang, found in out.items()
        for k, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)
    }


def prose(seed, n):
    r = random.Random(seed)
    words = ["aa", "Bb", "cc", "dd", "Éé", "x\x1cy", "#1", "“q”"]
    parts = [" ", "  ", "\t", ", ", ". ", "\n", "\x0b", "\r\n", " ; "]
    w = [8, 6, 5, 4, 3, 2, 1, 1]
    text = lambda: "".join(r.choices(words, w)[0] + r.choices(parts, [30, 1, 1, 2, 2, 1, 1, 1, 1])[0] for _ in range(r.randint(0, 60)))
    rows = [(r.choice(["en", "en", "de", "und", None]), text()) for _ in range(n)]
    return rows + [(None, None), ("en", None), ("fr", "aa bb"), ("es", ""), ("en", " .,;\n ")] + rows[:5] * 3


@pytest.mark.parametrize("places", [50, 400_000])
@pytest.mark.parametrize("words,min_count,share,top", [(3, 10, 50, 2000), (4, 4, 70, 2000), (2, 10, 50, 5), (3, 30, 50, 3)])
def test_against_brute_force(spark, tmp_path, monkeypatch, places, words, min_count, share, top):
    """One block or many, ties at the cut of the ranks, null and unknown languages, nulls, blanks of all kinds, clashing columns."""
    monkeypatch.setattr(co, "PLACES", places)
    rows = prose(words, 80)
    made = [(lang, text, "f", 1, 2, "w", 3) for lang, text in rows]
    spark.createDataFrame(made, "lang string, text string, words string, block int, n int, word string, id int").repartition(3).write.parquet(str(tmp_path / "t"))
    got = co.collocations(spark.read.parquet(str(tmp_path / "t")), min_count, words, share, top).collect()
    want = brute(rows, min_count, words, share, top)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 3


def test_edges(spark, docs, rows, none):
    """Very long texts and repeated rows give the same as plain Python; an empty table gives no rows."""
    got = {tuple(r) for r in co.collocations(docs, 3).collect()}
    assert got == brute([(r[2], r[1]) for r in rows], 3, 3, 50, 2000) and got
    out = co.collocations(none)
    assert out.collect() == [] and out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_score_beyond_64_bits(spark):
    a = 900_000_000_000_000
    d = spark.createDataFrame([(a, [a + 7, a + 1], [a + 3, a + 2])], "f long, lefts array<long>, rights array<long>")
    got = d.select(co.weakest_cut(d.f).alias("c")).first().c
    cuts = [10**6 * a * a // ((a + 7) * (a + 3)), 10**6 * a * a // ((a + 1) * (a + 2))]
    assert (got.score, got.cut) == min((s, k + 1) for k, s in enumerate(cuts))


def test_relations(spark):
    """A level keeps frequent groups alone, and joins neighbours of the same piece alone."""
    d = spark.createDataFrame([("en", "a b. c a b c"), ("en", "A  b\tz a b")], "lang string, text string").repartition(1)
    total, found = co.levels(d, 2, 3)
    assert [tuple(r) for r in total.collect()] == [("en", 11)]
    words = {r.id: r.word for r in found[0].collect()}
    assert sorted(words.values()) == ["a", "b", "c"]
    pairs = {r.id: (words[r.first], words[r.second], r.f) for r in found[1].collect()}
    assert sorted(pairs.values()) == [("a", "b", 4)]
    assert found[2].collect() == []
