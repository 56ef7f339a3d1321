"""The walk from seeds against plain Python: hubs in shards, masks of questions, the limit."""

import random
from collections import defaultdict

import pytest
from litmill.operators import graph
from pyspark.sql import functions as F


def brute(edges, seeds, hops, limit):
    edges = {e for e in edges if None not in e[:2]}
    out = []
    terms = defaultdict(set)
    for q, t in seeds:
        if (t or "").strip():
            terms[q].add(t.strip().lower())
    nodes = {x for s, d, _ in edges for x in (s, d)}
    for q, ts in terms.items():
        at = {n: 0 for n in nodes if any(t in n.lower() for t in ts)}
        for step in range(1, hops):
            for s, d, _ in edges:
                for a, b in ((s, d), (d, s)):
                    if at.get(a) == step - 1:
                        at.setdefault(b, step)
        facts = sorted((min(at[x] for x in (s, d) if x in at), s, t, d) for s, d, t in edges if any(at.get(x, hops) < hops for x in (s, d)))
        out += [(q, k, s, t, d) for k, (_, s, t, d) in enumerate(facts[:limit])]
    return sorted(out)


def walked(spark, edges, seeds, **how):
    e = spark.createDataFrame(edges, "src string, dst string, type string")
    s = spark.createDataFrame(seeds, "query_id long, term string")
    return sorted((r.query_id, r.fact_no, r["head"], r.rel, r["tail"]) for r in graph.khop_facts(e, s, **how).collect())


def made(seed, n=60, m=150, questions=150):
    """Nodes with names that hold each other, one of them a hub that has an end in most edges; more questions than a mask has bits."""
    r = random.Random(seed)
    names = [f"Node {k}" for k in range(n)] + ["x", "ab", "Attention Model", "attention", "é ü long name with many words"]
    edges = [(r.choice(names), r.choice(names), r.choice("RS")) for _ in range(m)]
    edges += [("Hub", f"Node {k}", "R") for k in range(n)] + [("Node 3", "Hub", "S"), ("Hub", "Hub", "R"), (None, "x", "R"), ("x", None, "R")]
    terms = ["node 1", "NODE 12", "hub", "x", "ab", "attention mod", "attention modem", "é", "ü long name w", "", None, " node 5 ", "many words", "e 4"]
    return edges + edges[:9], [(q, r.choice(terms)) for q in range(questions) for _ in range(r.randint(1, 3))]


@pytest.mark.parametrize("hops,limit,hub", [(1, 60, 1000), (2, 60, 7), (3, 25, 7), (3, 1000, 1000)])
def test_walk_equals_brute_force(spark, hops, limit, hub):
    edges, seeds = made(hops)
    got = walked(spark, edges, seeds, hops=hops, limit=limit, hub=hub)
    assert got == brute(edges, seeds, hops, limit) and len(got) > 100


def test_a_hub_is_dealt_to_shards(spark):
    """No (node, shard), which one task joins, holds more than about ``hub`` edges, whatever the hub's share of all."""
    edges = [("Hub", f"n{k}", "R") for k in range(5000)] + [(f"n{k}", f"n{k + 1}", "R") for k in range(50)]
    ends, hubs = graph.sharded_ends(spark.createDataFrame(edges, "src string, dst string, type string"), 100)
    assert [(r.a, r.shards) for r in hubs.collect()] == [("Hub", 50)]
    sizes = [r["count"] for r in ends.groupBy("a", "shard").count().collect()]
    assert max(sizes) < 200 and sum(sizes) == 2 * len(edges)
    got = walked(spark, edges, [(1, "n4999"), (2, "hub")], hops=2, limit=60, hub=100)
    assert got == brute(edges, [(1, "n4999"), (2, "hub")], 2, 60)


def test_terms_meet_ids_on_pieces_of_their_length(spark):
    """Terms of each length up to GRAM and beyond, and none."""
    ids = ["part123x", "apart", "a", "PART1", "supplier of parts", "p"]
    edges = [(a, "zz", "R") for a in ids]
    terms = ["p", "pa", "par", "part", "part1", "part12", "part123", "part123x", "supplier", "supplier of", "supplier on", "zzz"]
    seeds = list(enumerate(terms))
    assert walked(spark, edges, seeds, hops=1, limit=60) == brute(edges, seeds, 1, 60)
    assert walked(spark, edges, [(1, "")], hops=2, limit=60) == []
    nodes = spark.createDataFrame([(x,) for x in ids], "id string")
    s = spark.createDataFrame([(1, "part1")], "query_id long, term string")
    found = graph._seed_nodes(nodes, s, graph._numbered(s, "query_id"), "query_id")
    assert sorted(r.id for r in found.collect()) == ["PART1", "part123x"]
    assert found.select(F.bit_count("mask").alias("n")).distinct().collect()[0].n == 1


def test_a_question_meets_only_the_ends_it_can_take(spark):
    edges = spark.createDataFrame([("hub", f"n{k:03d}", "A") for k in range(300)] + [("other", "n001", "B")], "src string, dst string, type string")
    ends, _ = graph.sharded_ends(edges, 100)
    front = spark.createDataFrame([("hub", 0, 5), ("n001", 0, 2)], "id string, block long, mask long")
    got = graph._nearest_ends(front, ends, 4).collect()
    shards = {(r.a, r.shard) for r in got}
    assert {a for a, _ in shards} == {"hub", "n001"} and len(got) <= 4 * len(shards)
    assert {r.b for r in got if r.a == "n001"} == {"hub", "other"}
    assert {f"n{k:03d}" for k in range(4)} <= {r.b for r in got if r.a == "hub"}
