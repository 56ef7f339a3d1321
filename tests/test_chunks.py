import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
from litmill.operators import chunking
from litmill.operators.chunking import keywords_of
from litmill.operators.papers import inferred_tags_of
from pyspark.sql import functions as F


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def pack(paras, size, overlap):
    """Brute force of the paragraph windows."""
    out, cur = [], []
    n = lambda ps: sum(len(p.split()) for p in ps)
    for p in paras:
        w = len(p.split())
        if w > int(size * 1.5):
            ws = p.split()
            out += [" ".join(ws[i : i + size]) for i in range(0, len(ws), max(1, size - overlap))]
            continue
        if cur and n(cur) + w > size:
            out.append("\n\n".join(cur))
            kept = []
            for q in reversed(cur):
                if kept and n(kept) + len(q.split()) > overlap:
                    break
                kept.insert(0, q)
            cur = kept if overlap > 0 else []
        cur.append(p)
    return out + (["\n\n".join(cur)] if cur else [])


def test_windows_equal_brute_force(spark):
    rnd = random.Random(1)
    paras = [" ".join(rnd.choice("abc def gh".split()) for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    got = [r.text for r in chunking.window_chunks(docs(spark, "\n\n".join(paras)), 20, 6).orderBy("window_no").collect()]
    assert got == pack(paras, 20, 6)


def test_boundary_chunks_cover_and_respect_breaks(spark):
    text = ("Sentence one is here. " * 50 + "\n\n") * 6
    rows = chunking.boundary_chunks(docs(spark, text), 800, 100, None).orderBy("chunk_no").collect()
    assert rows[0].start == 0 and rows[-1].stop == len(text)
    assert all(a.stop > b.start for a, b in zip(rows, rows[1:]))
    assert all(r.text == text[r.start : r.stop] for r in rows)
    assert chunking.boundary_chunks(docs(spark, text), 800, 100, 3).count() == 3


def test_pages_and_sections(spark):
    text = "\n--- Page 1 ---\nAbstract\nfirst\n--- page 2 ---\n2.1 Setup here\nbody\nReferences\n[1] x"
    pages = chunking.split_pages(docs(spark, text))
    assert [(r.page_num) for r in pages.orderBy("page_num").collect()] == [1, 2]
    rows = [(r.title, r.text) for r in chunking.split_sections(pages).orderBy("page_num", "section_no").collect()]
    assert rows == [("Abstract", "first"), ("2.1 Setup here", "body")]


def test_recursive_chunks_fit(spark):
    text = "\n\n".join("word " * 60 for _ in range(10))
    rows = chunking.recursive_chunks(docs(spark, text), 200, 40).collect()
    assert rows and all(len(r.text) <= 200 for r in rows)


def test_semantic_chunks_split_on_size_and_stitch(spark):
    paras = [f"paragraph {i} " + "x" * 200 for i in range(8)]
    rows = chunking.semantic_chunks(docs(spark, "\n\n".join(paras)), 100, 300, 700).orderBy("chunk_no").collect()
    assert len(rows) > 1 and rows[1].text.startswith(rows[0].text.split("\n\n")[-1])


def test_canonical_sections_merge_headings(spark):
    md = "# T\n## Methods\na\n## Our Approach\nb\n## Limitations\nc"
    row = chunking.canonical_sections(docs(spark, md, "plain text")).orderBy("doc_id").collect()
    assert row[0].methodology == "a\n\nb" and row[0].limitations == "c"
    assert row[1].introduction == "plain text"


def test_keywords_of_a_text_with_many_words(spark):
    """Looking each of 200,000 words up among all of them would take minutes; ties keep the order of first use, whatever the alphabet says."""
    n = 200_000
    words = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("word"), F.reverse(F.lpad(i.cast("string"), 7, "0"))))
    text = F.concat(F.array_join(words, " "), F.lit(" zeta WORD3000000 Zeta word2000000 word3000000"))
    begun = time.time()
    row = spark.range(1).select(keywords_of(text, 5).alias("k"), inferred_tags_of(F.lit("beta alpha beta gamma alpha beta delta"), 3).alias("t")).first()
    assert time.time() - begun < 20
    assert row.k == ["word3000000", "word2000000", "zeta", "word1000000", "word4000000"]
    assert row.t == ["beta", "alpha", "gamma"]
    none = spark.createDataFrame([(None,), ("",), ("abc",)], "x string").select(keywords_of(F.col("x")).alias("k")).collect()
    assert [r.k for r in none] == [[], [], []]


def test_a_batch_of_documents_stays_in_arrow():
    """24 MB of vectors; a batch as lists of arrays would take more than that again. Some rows are a slice of a larger batch."""
    rng, n, width = np.random.default_rng(1), 1500, 32
    vectors = rng.normal(size=(n * width, 64))
    texts = [[f"paragraph {i} {j} " * 8 for j in range(width)] for i in range(n)]
    each = pa.ListArray.from_arrays(pa.array(np.arange(n * width + 1, dtype=np.int32) * 64), pa.array(vectors.ravel()))
    vs = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), each)
    ps = pa.array(texts, pa.list_(pa.string()))
    tracemalloc.start()
    out = chunking._grouped(ps, vs, 300, 700, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000
    right = [chunking._semantic_groups(t, list(vectors[i * width : (i + 1) * width]), 300, 700, 0.5) for i, t in enumerate(texts)]
    assert out.to_pylist() == right
    assert chunking._grouped(ps[7:9], vs[7:9], 300, 700, 0.5).to_pylist() == right[7:9]
    assert chunking._grouped(ps[:0], vs[:0], 300, 700, 0.5).to_pylist() == []
