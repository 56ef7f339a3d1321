"""Rare kinds of personal data stay in the training sample, however much else holds digits."""

import random

from litmill.llm import pii_spans


def test_rare_kinds_are_sampled_from_a_large_corpus(spark):
    r = random.Random(3)
    num = lambda n: "".join(str(r.randrange(10)) for _ in range(n))
    rows = [(f"version {k}.{num(3)} of", ) for k in range(3000)]
    rare = [f"host 10.{k}.7.{k} up" for k in range(5)] + ["card 4366 4989 4794 7848 it", "call +1 (477) 555-4197 now", "ask a.b@mail.example.com ok"]
    docs = spark.createDataFrame([*rows, *((t,) for t in rare)], "text string")
    for parts in (2, 5):
        got = pii_spans.sampled(docs.repartition(parts), 50)
        assert set(rare) <= set(got) and len(got) == 50 + len(rare)
        assert got == pii_spans.sampled(docs.union(docs).repartition(parts + 2), 50)  # copies take no places


def test_a_rare_kind_is_found_in_another_form_as_the_data_grow(spark):
    r = random.Random(5)
    rows = [(f"host 10.{r.randrange(256)}.{r.randrange(256)}.{k} up",) for k in range(40)] + [("so 64[.]69[.]158[.]108 is",)]
    noise = [(f"on {1000 + k} in {k}.{r.randrange(99)}",) for k in range(12_000)]
    docs = spark.createDataFrame(rows + noise, "text string").selectExpr("monotonically_increasing_id() as doc_id", "text")
    got = [(r.text[s.start : s.end], s.kind) for r in pii_spans.pii_spans(docs).where("text like '%[.]%'").collect() for s in r.spans]
    assert got == [("64[.]69[.]158[.]108", "ip")]
