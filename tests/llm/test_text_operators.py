"""Exact dedup, line dedup, Jaccard join, mixing, packing against plain Python on a table of edge cases."""

import hashlib
import re
import uuid
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from litmill.llm import exact_dedup, jaccard_join, line_dedup, mixing, packing, queries

BLANK = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())


def index(spark, tmp_path):
    return exact_dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}", str(tmp_path / "index"), 4)


def test_exact_dedup(spark, docs, rows, none, tmp_path):
    strip = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[strip(r[1])].append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
    want = Counter()
    for r in rows:
        g = groups[strip(r[1])]
        want[r[0], min(g)[3], len(g), r[0] == min(g)[3], hashlib.sha256(strip(r[1]).encode()).hexdigest()] += 1
    ix = index(spark, tmp_path)
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs, ix).collect())) == want
    # what comes later is found in the index; its sort-merge anti-join appends new digests alone
    n = ix.rows().count()
    later = spark.createDataFrame([(900, rows[0][1] + " "), (901, "a text that was never seen")], "doc_id long, text string")
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(later, ix).collect()}
    assert (got[900].keep_id, got[900].kept, got[901].kept) == (0, False, True) and ix.rows().count() == n + 1
    # rows that came before, null ids among them, keep their earlier document: none of the batch
    assert not any(r.kept for r in exact_dedup.exact_dedup(docs, ix).collect()) and ix.rows().count() == n + 1
    known = ix.known(spark.createDataFrame([(bytes(32), 1, 1)], exact_dedup.SCHEMA))
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange") == 1
    assert exact_dedup.exact_dedup(none, ix).collect() == []
    batch = spark.createDataFrame([(bytes(32), 1, 1)], exact_dedup.SCHEMA)
    plan = ix.unseen(batch)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange") == 1


def brute_lines(rows):
    low = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(BLANK))
    big = 2**63 - 1
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            holders[low(line)].add(big if r[0] is None else r[0])
    out = Counter()
    for r in rows:
        lines, me = (r[1] or "").split("\n"), big if r[0] is None else r[0]
        kept = [x for x in lines if not (len(low(x)) >= 10 and len(holders[low(x)]) > 1 and min(holders[low(x)]) != me)]
        out[r[0], len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def test_line_dedup(spark, docs, rows, none):
    out = line_dedup.line_dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = Counter(map(tuple, out.select("doc_id", "n_lines", "n_dropped", "text").collect()))
    assert got == brute_lines(rows) and any(k[2] for k in got)
    assert line_dedup.line_dedup(none).collect() == []
    # columns with the names that the operator works with come through as they are
    from pyspark.sql import functions as F

    mine = {"id": F.lit(77), "mark": F.lit("m"), "lines": F.lit(5), "_id": F.lit("x"), "_MARK": F.lit("y"), "n_lines": F.lit("gone")}
    clash = line_dedup.line_dedup(docs.withColumns(mine))
    assert Counter(map(tuple, clash.select("doc_id", "n_lines", "n_dropped", "text").collect())) == brute_lines(rows)
    assert {(r.id, r.mark, r.lines, r["_id"], r["_MARK"]) for r in clash.collect()} == {(77, "m", 5, "x", "y")}


def test_perfect_hash_is_minimal():
    import numpy as np

    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64))
    ph = line_dedup.PerfectHash.build(keys)
    assert sorted(ph.places(keys)) == list(range(len(keys)))
    with pytest.raises(ValueError):
        line_dedup.PerfectHash.build(keys[[0, 0]])


def brute_components(rows):
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    low = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[find(k)] = min(low.get(find(k), r[0]), r[0])
    return Counter((r[0], len(sets[k]), low.get(find(k)) if sets[k] else r[0]) for k, r in enumerate(rows))


def test_jaccard_components(spark, docs, rows, none):
    got = Counter(map(tuple, jaccard_join.similarity_components(docs).collect()))
    assert got == brute_components(rows)
    assert jaccard_join.similarity_components(none).collect() == []


@pytest.mark.parametrize("short", [2, 64])
def test_jaccard_near_the_threshold(spark, monkeypatch, short):
    """Large groups of near copies whose pairs lie on both sides of the threshold, through long lists and short ones."""
    import random

    monkeypatch.setattr(jaccard_join, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard_join, "LEADERS", 2)
    r = random.Random(3)
    base = [[f"b{g}w{k}" for k in range(60)] for g in range(3)]
    rows = []
    for i in range(150):
        w = list(base[i % 3])
        for _ in range(r.choice([1, 1, 2])):
            w[r.randrange(60)] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert Counter(map(tuple, jaccard_join.similarity_components(docs).collect())) == want
    assert 3 <= len({k[2] for k in want}) < 150


def test_mixing(spark, docs, rows, none, sf_dir):
    got = queries.QUERIES["op8_fair_mix"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, budget, target = set(size), 1.5 * sum(size.values()), {}
    while left:
        level = budget / sum(weight[s] for s in left)
        full = {s for s in left if 2 * size[s] <= level * weight[s]}
        for s in full or left:
            target[s] = 2.0 * size[s] if full else level * weight[s]
            budget -= target[s] if full else 0
        left -= full or left
    taken, of = Counter(), {}
    for g in got:
        assert 0 <= g.taken <= 2 * g.size
    by = defaultdict(list)
    for r in rows:
        by[r[0], len(words(r[1]))].append(r[3])
    for g in got:
        s = by[g.doc_id, g.size].pop()
        taken[s] += g.taken
        of[s] = g
    for s in size:
        assert of[s].source_size == size[s] and of[s].target == pytest.approx(target[s]) and abs(taken[s] - target[s]) < 1.001
    again = sorted(map(str, queries.QUERIES["op8_fair_mix"](spark, sf_dir).collect()))
    assert again == sorted(map(str, got))
    _, mix = mixing.fair_mix(docs)
    at = mix.orderBy("position").collect()
    assert [m.finish for m in at] == sorted(m.finish for m in at) and at[-1].position + at[-1].words == sum(m.words for m in at)
    assert [x.count() for x in mixing.fair_mix(none)] == [0, 0]


def test_packing(spark, docs, rows, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.word_file())
    for size in (64, 2048):
        want = Counter()
        for r in rows:
            ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
            for k in range(0, len(ids), size):
                part = ids[k : k + size]
                want[r[0], k // size, k, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
        got = packing.pack_documents(docs, size=size).collect()
        assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
        places = defaultdict(list)
        for g in got:
            places[g.sequence_id].append((g.offset, g.length))
        for p in places.values():
            end = 0
            for a, n in sorted(p):
                assert a == end
                end += n
            assert end <= size
        assert len(places) <= 1.1 * sum(g.length for g in got) / size + 1
    assert packing.pack_documents(none).collect() == []


def test_plan_is_best_fit_decreasing():
    import random

    r = random.Random(1)
    for _ in range(50):
        lengths = [r.randint(1, 100) for _ in range(r.randint(1, 200))]
        room = []
        for n in sorted(lengths, reverse=True):
            fit = min((x for x in room if x >= n), default=None)
            if fit is None:
                room.append(100 - n)
            else:
                room.remove(fit)
                room.append(fit - n)
        slots = packing.plan(Counter(lengths), 100)
        ids = {first + k for _, a, b, first, each, _ in slots for k in range(-(-(b - a) // each))}
        assert len(ids) == len(room)
        assert sum(b - a for _, a, b, *_ in slots) == len(lengths)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    out = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in out.description]
    got = queries.QUERIES[name](spark, d).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(out.fetchall())


def test_numbers_of_the_pipeline(spark, sf_dir, rows):
    import corpus_pipeline

    docs, names = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    names = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == names
    before = {r.doc_id for r in seen["language"]}
    assert not before & {200, 201, 202, 203, 204} and len(before) > 40
    want = Counter(k[3] for k in brute_lines([(r.doc_id, r.text) for r in seen["language"]]).elements())
    assert Counter(r.text for r in seen["lines"]) == want
    groups = brute_components([(r.doc_id, r.text) for r in seen["lines"]])
    assert sorted({k[2] for k in groups if k[2] is not None}) == sorted(r.doc_id for r in seen["near_duplicates"] if r.doc_id is not None)
    copies = Counter(r.doc_id for r in seen["mixing"])
    assert max(copies.values()) <= 2 and set(copies) <= {r.doc_id for r in seen["near_duplicates"]}
    assert {r.doc_id for r in seen["packing"]} == set(copies)
    assert Counter(r.doc_id for r in seen["packing"] if r.piece == 0) == copies
