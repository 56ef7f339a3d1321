"""Media, personal data, language model, URL filter and language ID: round trips, brute force and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from litmill.llm import avi_media as A
from litmill.llm import language_id, pii_spans, pitman_yor, queries, url_filter
from pyspark.sql import functions as F


def test_media_round_trip(spark, docs, rows, none, sf_dir):
    got = queries.QUERIES["op1_avi_media"](spark, sf_dir).collect()
    want = Counter()
    for r in rows:
        t = (r[1] or "").encode()
        p = t + bytes(-len(t) % 64 if t else 64)
        want[r[0], len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((g.doc_id, g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) for g in got) == want
    assert all(g.error is None and g.n_frames >= g.n_clips >= 1 for g in got)
    assert A.read_avi(A.with_avi(none)).collect() == []
    clips = A.clip_rows(A.read_avi(A.with_avi(docs)))
    ends = clips.groupBy("doc_id", "n_frames").agg(F.sum(F.col("end_frame") - F.col("first_frame")).alias("n")).where("doc_id >= 300")
    assert all(r.n == r.n_frames for r in ends.collect())


def test_media_is_a_plain_film(spark):
    """Java's own JPEG reader sees our bytes; we see the frames that its writer makes."""
    jvm = spark._jvm
    payload = np.random.default_rng(2).integers(0, 256, 64 * 20, dtype=np.uint8).tobytes()
    film = A.films([payload])[0]
    a, b = A.parse_avi(film)["frames"][0]
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(film[a:b]))
    seen = [image.getRaster().getSample(8 * x + 3, 8 * y + 5, 0) for y in range(16) for x in range(64)]
    assert bytes(seen) == payload[:1024]
    frames = []
    for shade in (40, 40, 40, 200, 200):
        image = jvm.java.awt.image.BufferedImage(96, 64, 1)
        for y in range(64):
            for x in range(0, 96):
                image.setRGB(x, y, (shade + x // 8) * 0x10101)
        out = jvm.java.io.ByteArrayOutputStream()
        jvm.javax.imageio.ImageIO.write(image, "jpg", out)
        frames.append(bytes(out.toByteArray()))
    got = A.read_films([A.avi_file(frames, 96, 64, 0), film[:-900], b"no film", None])
    assert [(c["first_frame"], c["end_frame"], c["start_s"]) for c in got[0]["clips"]] == [(0, 3, 0.0), (3, 5, 3 / A.FPS)]
    assert abs(got[0]["clips"][0]["luma"] - 45.5) < 2 and abs(got[0]["clips"][1]["luma"] - 205.5) < 2
    assert got[1]["error"] and got[2]["error"] and got[3] is None


def test_media_without_an_index():
    film = A.films([bytes(range(64)) * 40])[0]
    cut = film.index(b"idx1")
    bare = film[:4] + (cut - 8).to_bytes(4, "little") + film[8:cut]
    assert A.read_films([bare])[0]["payload"] == bytes(range(64)) * 40


PLAIN = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (13 <= len(digits) <= 19 and pii_spans.luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans():
    r = random.Random(1)
    for _ in range(5000):
        text = "".join(r.choice("1234567890..@@ab+- ()\né") for _ in range(r.randint(0, 60)))
        assert pii_spans.base_spans(text) == brute_spans(text)
    assert pii_spans.base_spans("1" * 100_000 + " " + "a" * 100_000) == []


def test_personal_data(spark, docs, rows, none, sf_dir):
    got = queries.QUERIES["op2_pii_spans"](spark, sf_dir).collect()
    by = Counter()
    for r in rows:
        spans = brute_spans(r[1] or "")
        text = ",".join(f"{pii_spans.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        by[(r[0], *[sum(s[0] == k for s in spans) for k in range(4)], hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((g.doc_id, g.n_email, g.n_ip, g.n_card, g.n_phone, g.base_sha256) for g in got) == by
    assert pii_spans.pii_spans(none).collect() == []


def test_field_finds_rewritten_data_and_leaves_the_rest():
    r = random.Random(4)
    num = lambda n: "".join(str(r.randrange(10)) for _ in range(n))

    def card():
        while True:
            c = "4" + num(15)
            if pii_spans.luhn(c):
                return c

    texts = [f"so {r.choice(['a.b', 'kim'])}.{num(2)}@mail{num(1)}.example.com was" for _ in range(40)]
    texts += [f"at {r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)} is" for _ in range(40)]
    texts += [f"of {card()} the" for _ in range(40)] + [f"call +1 ({num(3)}) 555-{num(4)} now" for _ in range(40)]
    texts += [f"password={num(4)}ab{num(3)}c", "version 2.0", f"in {num(4)}", f"token = 7c{num(6)}ef{num(2)}", "CC BY-NC 4.0."] * 8
    w = pii_spans.learn(texts)
    found = lambda t: [(pii_spans.KINDS[k], t[a:b]) for x, y in pii_spans.regions(t) for k, a, b in pii_spans.best(pii_spans.Region(t, x, y), w)]
    c = card()
    assert found("call 477-555-4197 now") == [("phone", "477-555-4197")]
    assert found(f"so {c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]} it") == [("card", f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}")]
    assert found("so 64[.]69[.]158[.]108 is") == [("ip", "64[.]69[.]158[.]108")]
    assert [k for k, _ in found("ask kim.22(at)mail3(dot)example(dot)com ok")] == ["email"]
    assert not any(found(t) for t in ("version 2.0.1", "in 1998", "CC BY-NC 4.0.", "pi 3.14159", "password=29e5b7d2b3fc74d679", "on 2024-10-12 at 10:22"))
    # the sums over all segmentations give the slope of the likelihood
    region = pii_spans.Region("at 1.2.3.4 x 5", 0, 14)
    gold = [(1, 3, 10)]

    def likelihood(w):
        def total(j, only):
            parts = [total(j - 1, only)] if j else [0.0]
            for i, f in region.ends[j] if j else []:
                for k in range(4):
                    if not only or (k, region.edges[i], region.edges[j]) in only:
                        parts.append(total(i, only) + pii_spans.segment_score(w, k, f))
            return math.log(sum(map(math.exp, parts))) if j else 0.0

        at = {e: k for k, e in enumerate(region.edges)}
        i, j = at[3], at[10]
        own = next(f for a, f in region.ends[j] if a == i)
        return pii_spans.segment_score(w, 1, own) - total(len(region), None)

    w0 = {(1, "four"): 0.3, (0, "bias"): -0.2, (3, "bias"): 0.1}
    slope = pii_spans.gradient(region, gold, w0)
    for key in ((1, "four"), (1, "bias"), (0, "bias"), (3, "bias")):
        more = likelihood(w0 | {key: w0.get(key, 0.0) + 1e-5}) - likelihood(w0)
        assert slope.get(key, 0.0) == pytest.approx(more / 1e-5, abs=1e-3)


def test_pitman_yor(spark, docs, rows, none, sf_dir):
    got = queries.QUERIES["op3_pitman_yor"](spark, sf_dir).collect()
    toks = lambda t: [*re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()), b""]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    c = Counter()
    for r in rows:
        if not held(r[0]):
            c.update(toks(r[1]))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in rows:
        t = toks(r[1])
        want[r[0], held(r[0]), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 5)] += 1
    assert Counter((g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 5)) for g in got) == want
    assert sum(g.score for g in got if g.doc_id and g.doc_id < 100) > sum(g.base_score for g in got if g.doc_id and g.doc_id < 100)
    assert pitman_yor.pitman_yor_scores(none, F.lit(False)).collect() == []


def test_url_filter(spark, none):
    urls = ["https://a.example.org/es/1", "http://EXAMPLE.org/en/12?x=1", "http://x.org", "http://x.org/", "http://org/a#b", "ftp://notorg/", "a.com/fr/", "http://b.com/fr/x", "http://com/de/",
            "http://example.com/en", None, "", "://", "http://a.xorg/", "https://example.org/en/2", "http://u:p@Z.COM:80/de/", "http://c.com/DE/", "://b.com/fr/://com/de/"]
    rows = [(k, u, "x", 1.0) for k, u in enumerate(urls * 3)] + [(k + 100, f"http://h{k}.com/{'fr' if k % 2 else 'de'}/{k}{'?a=1' if k % 2 else ''}", "y", 0.0) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, label string, f_length double")
    got = url_filter.url_filter(pages).collect()
    assert len(got) == len(rows)

    def brute(u):
        u = u or ""
        host = path = ""
        if "://" in u:
            after = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", after).group()
            path = re.match(r"[^?#]*", after[len(host) :]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        best = None
        for verdict, rule in url_filter.RULES:
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
                best = verdict, rule
        return host, path, best

    of = {r[0]: r[1] for r in rows}
    for g in got:
        host, path, best = brute(of[g.page_id])
        assert (g.host, g.path, g.rule) == (host, path, best and best[1])
        assert g.verdict in ("allow", "block") and (best is None or g.verdict == best[0])
    assert url_filter.url_filter(pages.limit(0)).collect() == []
    bare = spark.createDataFrame([(1, "http://a.net/"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in url_filter.url_filter(bare).collect()} == {"allow"}


def test_trees_learn_from_the_text(spark):
    """Held-out URLs of hosts without a rule: those that look like the blocked ones are blocked."""
    r = random.Random(6)
    rows = []
    for k in range(600):
        bad = k % 2
        host = f"h{r.randrange(40)}.{'net' if k % 3 == 0 else 'com'}"
        rows.append((k, f"http://{host}/{'de' if bad else 'fr'}/{'-'.join(str(r.randrange(9999)) for _ in range(4)) + '?a=1&b=2&c=3' if bad else 'page'}"))
    got = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string")).where("rule is null").collect()
    right = sum((g.verdict == "block") == bool(g.page_id % 2) for g in got)
    assert len(got) == 200 and right / len(got) > 0.95


def test_language_id(spark, docs, rows, none, sf_dir):
    got = queries.QUERIES["op7_language_id"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    texts = {r[0]: (r[1], r[2]) for r in rows if r[0] is not None and r[0] < 300}
    for g in got:
        text, lang = texts.get(g.doc_id, ("x", None))
        has = text is not None and any(c.isalpha() for c in text)
        assert (g.lang_pred == "und") == (g.doc_id in texts and not has) or g.doc_id is None
        assert 0 <= g.score <= 1
        if g.doc_id is not None and g.doc_id < 40:
            assert g.lang_pred == lang and not g.rejected
    model = language_id.fit(none)
    assert model.langs == [] and {r.lang_pred for r in language_id.identify(docs, model).collect()} == {"und"}
    assert language_id.identify(none, model).collect() == []


def test_language_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.QUERIES["op7_language_id"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n, gone = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.sum(F.col("rejected").cast("int"))).first()
    assert n > 300 and right > 0.99 and gone == 0
