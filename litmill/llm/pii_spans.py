"""Personal data by a semi-Markov conditional random field.

The base spans come from four patterns. The field sees the neighbourhoods of digits and at-signs: a neighbourhood is a row
of pieces (letters, digits, signs, blanks), a candidate is any run of at most LONGEST pieces, and its score is a sum of
weights of features of the whole run. Dynamic programming over pieces chooses boundaries and kinds together. The weights are
learned from base spans of the corpus and rewritten forms of them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmill.llm.common import table

KINDS = ("email", "ip", "card", "phone")
LONGEST = 24
TRAIN_REGIONS, TRAIN_CHARS = 500, 200
EPOCHS, RATE, DECAY = 4, 0.5, 1e-3
MARGIN = 3.0
CANDIDATE = r"[0-9@]|[\[(]at[\])]"

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
PIECE = re.compile(r"[A-Za-z]+|[0-9]+|\s+|[^A-Za-z0-9\s]")
WORD = re.compile(r"\S+")
HIDDEN_AT = re.compile(r"[\[(]at[\])]")
CONTEXT = {"tel": 3, "phone": 3, "call": 3, "mobile": 3, "fax": 3, "mail": 0, "email": 0, "card": 2, "visa": 2, "ip": 1, "host": 1}

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the four patterns, by kind and start; linear in the text's length."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    for m in DOTTED.finditer(text):
        at, parts = m.start(), m.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                out.append((1, at, at + size))
            at += size + 1
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Runs of words that hold a digit, an at-sign or a hidden one; a hidden at-sign takes its two neighbours on both sides."""
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    use = set()
    for k, (a, b) in enumerate(words):
        w = text[a:b]
        if any(c in "0123456789@" for c in w):
            use.add(k)
        elif HIDDEN_AT.search(w):
            use.update(range(max(0, k - 1), min(len(words), k + 4)))
    first = last = None
    for k in sorted(use):
        if last is not None and k == last + 1 and words[k][0] - words[last][1] <= 2:
            last = k
            continue
        if last is not None:
            yield words[first][0], words[last][1]
        first = last = k
    if last is not None:
        yield words[first][0], words[last][1]


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


@lru_cache(maxsize=50_000)
def features(s: str, before: str, after: str, context: int) -> tuple[str, ...]:
    """Features of a whole candidate; before, after: the characters beside it; context: the kind a word before it names, or -1."""
    groups = re.findall("[0-9]+", s)
    digits = "".join(groups)
    out = [f"digits{_bucket(len(digits), (1, 4, 7, 9, 10, 12, 13, 16, 17, 20))}", f"groups{min(len(groups), 6)}", f"longest{_bucket(max(map(len, groups), default=0), (1, 3, 4, 5, 9, 13))}"]
    if not digits and "@" not in s and not HIDDEN_AT.search(s):
        return ()
    if "@" in s or HIDDEN_AT.search(s):
        out.append("at")
        plain = re.sub(r"\s*[\[(]at[\])]\s*", "@", re.sub(r"\s*[\[(]dot[\])]\s*", ".", s)).replace(" @ ", "@")
        spans = base_spans(plain)
        out.append("address" if spans[:1] == [(0, 0, len(plain))] else "no_address")
    elif re.search("[A-Za-z]", s):
        out.append("letters")
    dotted = re.sub(r"\s*(\[\.\]|\.)\s*", ".", s)
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", dotted):
        out.append("four" if all(len(p) <= 3 and int(p) <= 255 for p in dotted.split(".")) else "four_large")
    if 13 <= len(digits) <= 19 and not re.search("[A-Za-z@+]", s):
        out.append("luhn" if luhn(digits) else "no_luhn")
        out.append(f"even{int(all(len(g) == 4 for g in groups[:-1]))}")
    if s[0] == "+":
        out.append("plus")
    if re.match(r"(\+?1[ .-]?)?(\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}$", s):
        out.append("three_three_four")
    for sign, name in ((" ", "blank"), ("-", "dash"), (".", "dot"), ("(", "round"), ("[", "square"), (":", "colon"), ("/", "slash"), ("=", "equals"), (",", "comma"), ('"', "quote")):
        if sign in s:
            out.append(name)
    if re.search(r"[^A-Za-z0-9 .()+@\[\]_%-]", s):
        out.append("other")
    if len(after) > 1 and after[0] in ".-@_" and after[1].isalnum():
        out.append("goes_on")
    if before.isalnum() or after[:1].isalnum():
        out.append("inside")
    if before in "-.+=_/@" and before:
        out.append("joined")
    if s[0] in ").-" or s[-1] in "(.-+[":
        out.append("ragged")
    if s.count("(") != s.count(")") or s.count("[") != s.count("]"):
        out.append("unbalanced")
    if context >= 0:
        out.append(f"said_{KINDS[context]}")
    return tuple(out)


class Region:
    """Pieces of a neighbourhood and its candidates: (first piece, end, features)."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.start = text, start
        cuts = [(m.start(), m.end()) for m in PIECE.finditer(text, start, end)]
        self.edges = [a for a, _ in cuts] + [end]
        blank = [text[a].isspace() for a, _ in cuts]
        counted = [0]
        for a, b in cuts:
            counted.append(counted[-1] + (b - a if "0" <= text[a] <= "9" else 0))
        said = -1
        for w in re.findall("[a-z]+", text[max(0, start - 24) : start].lower())[-2:]:
            said = CONTEXT.get(w, said)
        ats = [0]
        for a, b in cuts:
            ats.append(ats[-1] + (text[a] == "@" or text[a:b] == "at"))
        self.ends: list[list[tuple[int, tuple[str, ...]]]] = [[] for _ in range(len(cuts) + 1)]
        for i in range(len(cuts)):
            if blank[i]:
                continue
            for j in range(i + 1, min(len(cuts), i + LONGEST) + 1):
                n = counted[j] - counted[i]
                if n > 19 and ats[j] == ats[i]:
                    break
                if blank[j - 1] or not (4 <= n <= 19 or ats[j] > ats[i]):
                    continue
                a, b = self.edges[i], self.edges[j]
                found = features(text[a:b], text[max(0, a - 1) : a], text[b : b + 2], said)
                if found:
                    self.ends[j].append((i, found))

    def __len__(self) -> int:
        return len(self.edges) - 1


Weights = dict[tuple[int, str], float]


def segment_score(w: Weights, kind: int, found: tuple[str, ...]) -> float:
    s = w.get((kind, "bias"), 0.0)
    for f in found:
        s += w.get((kind, f), 0.0)
    return s


def best(region: Region, w: Weights) -> list[Span]:
    """The best segmentation's typed spans whose own score is at least MARGIN. A piece outside any span scores 0."""
    n = len(region)
    top: list[float] = [0.0] + [-math.inf] * n
    back: list[tuple[int, int, float]] = [(0, -1, 0.0)] * (n + 1)
    for j in range(1, n + 1):
        top[j], back[j] = top[j - 1], (j - 1, -1, 0.0)
        for i, found in region.ends[j]:
            for kind in range(len(KINDS)):
                s = segment_score(w, kind, found)
                if s > 0 and top[i] + s > top[j]:
                    top[j], back[j] = top[i] + s, (i, kind, s)
    out, j = [], n
    while j:
        i, kind, s = back[j]
        if kind >= 0 and s >= MARGIN:
            out.append((kind, region.edges[i], region.edges[j]))
        j = i
    return out[::-1]


def gradient(region: Region, gold: list[Span], w: Weights) -> dict[tuple[int, str], float]:
    """Observed minus expected features, by sums over all segmentations forward and backward."""
    n = len(region)
    at = {e: k for k, e in enumerate(region.edges)}
    true = {(at[a], at[b], kind) for kind, a, b in gold if a in at and b in at}
    scores = [[(i, found, [segment_score(w, k, found) for k in range(len(KINDS))]) for i, found in region.ends[j]] for j in range(n + 1)]
    forward = [0.0] * (n + 1)
    for j in range(1, n + 1):
        parts = [forward[j - 1], *(forward[i] + s for i, _, own in scores[j] for s in own)]
        high = max(parts)
        forward[j] = high + math.log(sum(math.exp(p - high) for p in parts))
    backward = [0.0] * (n + 1)
    follow: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for j in range(n + 1):
        for i, _, own in scores[j]:
            follow[i] += [(j, s) for s in own]
    for i in range(n - 1, -1, -1):
        parts = [backward[i + 1], *(backward[j] + s for j, s in follow[i])]
        high = max(parts)
        backward[i] = high + math.log(sum(math.exp(p - high) for p in parts))
    out: dict[tuple[int, str], float] = {}
    for j in range(n + 1):
        for i, found, own in scores[j]:
            for kind, s in enumerate(own):
                d = ((i, j, kind) in true) - math.exp(forward[i] + s + backward[j] - forward[n])
                if abs(d) > 1e-6:
                    for f in ("bias", *found):
                        out[kind, f] = out.get((kind, f), 0.0) + d
    return out


def rewritten(kind: int, s: str, rng: np.random.Generator) -> tuple[str, bool]:
    """Another form of a base span, and whether it is personal data still."""
    digits = re.sub("[^0-9]", "", s)
    pick = int(rng.integers(6))
    if kind == 0:
        name, _, host = s.partition("@")
        return [(f"{name} [at] {host}", True), (f"{name}(at){host.replace('.', '(dot)')}", True), (f"{name}[at]{host.replace('.', '[dot]')}", True),
                (f"{name} @ {host}", True), (f"{name}@", False), (f"@{host.split('.')[0]}", False)][pick]
    if kind == 1:
        p = s.split(".")
        return [("[.]".join(p), True), (f"{p[0]}.{p[1]}.{p[2]}[.]{p[3]}", True), (".".join(p[:3]), False), (".".join([*p[:3], str(256 + int(rng.integers(700)))]), False),
                (f"{p[0]}.{p[1]}", False), (" . ".join(p), True)][pick]
    if kind == 2:
        four = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + int(rng.integers(8))) % 10)
        return [(".".join(four), True), ("/".join(four), True), (wrong, False), (digits[:11], False), ("-".join([*four[:-1], wrong[-len(four[-1]) :]]), False), ("_".join(four), True)][pick]
    own = digits[-10:]
    a, b, c = own[:3], own[3:6], own[6:]
    return [(f"({a}) {b}-{c}", True), (f"{a}-{b}-{c}", True), (f"{a}.{b}.{c}", True), (own[:8], False), (f"{a}{b}", False), (f"20{a[:2]}-0{b[0]}-1{c[0]}", False)][pick]


def learn(samples: list[str], seed: int = 7) -> Weights:
    """Weights from texts around base spans: each as it is, and with its spans rewritten. No texts give no weights."""
    rng = np.random.default_rng(seed)
    cases: list[tuple[Region, list[Span]]] = []
    for text in samples:
        forms = [(text, base_spans(text))]
        for _ in range(2):
            new, gold, at = "", [], 0
            for kind, a, b in sorted(base_spans(text), key=lambda x: (x[1], -x[2])):
                if a < at:
                    continue
                form, ok = rewritten(kind, text[a:b], rng)
                new += text[at:a]
                if ok:
                    gold.append((kind, len(new), len(new) + len(form)))
                new, at = new + form, b
            forms.append((new + text[at:], gold))
        for t, gold in forms:
            for a, b in regions(t):
                cases.append((Region(t, a, b), [g for g in gold if a <= g[1] and g[2] <= b]))
    w: Weights = {}
    squares: Weights = {}
    for _ in range(EPOCHS):
        for k in rng.permutation(len(cases)).tolist():
            region, gold = cases[k]
            if len(region) > 120:
                continue
            for f, g in gradient(region, gold, w).items():
                g -= DECAY * w.get(f, 0.0)
                squares[f] = squares.get(f, 1e-6) + g * g
                w[f] = w.get(f, 0.0) + RATE * g / math.sqrt(squares[f])
    return w


def sampled(docs: DataFrame, rows: int = TRAIN_REGIONS) -> list[str]:
    """Texts of at most TRAIN_CHARS around digits and at-signs, chosen by hashes: the bound of the training set.

    For each kind at most ``rows`` distinct ones that hold a base span of it, and at most ``rows`` that hold none.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, int]] = [{} for _ in range(len(KINDS) + 1)]  # the last one: without a base span
        least = lambda own: dict(sorted(own.items(), key=lambda x: (x[1], x[0]))[:rows])
        for b in batches:
            for text in b.column(0):
                t = text.as_py()
                for a, e in regions(t) if t is not None else ():
                    if e - a > TRAIN_CHARS - 60:
                        continue
                    start = max(0, a - 40)
                    near = t[start : e + 20]
                    code = int.from_bytes(blake2b(near.encode(), digest_size=8).digest(), "big", signed=True)
                    for k in {k for k, x, y in base_spans(near) if a <= start + x and start + y <= e} or {len(KINDS)}:
                        held[k][near] = code
                        if len(held[k]) > 4 * rows:
                            held[k] = least(held[k])
        found = [(k, near, code) for k, own in enumerate(held) for near, code in least(own).items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.int64()))], ["kind", "near", "code"])

    near = docs.select(F.when(F.col("text").rlike(CANDIDATE), F.col("text")).alias("text")).where("text is not null").mapInArrow(choose, "kind int, near string, code long")
    place = F.row_number().over(Window.partitionBy("kind").orderBy("code", "near"))
    chosen = near.distinct().withColumn("place", place).where(F.col("place") <= rows).select("code", "near").distinct()
    return [r["near"] for r in sorted(chosen.collect(), key=lambda r: (r["code"], r["near"]))]


def pii_spans(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """``docs`` (doc_id, text and any others but spans, n_base) with spans array<struct<kind,start,end,base>>.

    Places are code points, ends exclusive; by kind and start. ``base``: the patterns found it; the others are the field's, which
    overlap no base span. Null and empty texts have none. The field learns from ``docs`` unless ``weights`` are given; with
    nothing to learn from it adds nothing. Whole texts are read. Rows that repeat come back as often; an empty table gives no
    rows. Texts without a digit or at-sign don't leave the JVM.
    """
    w = learn(sampled(docs)) if weights is None else weights
    @F.pandas_udf("array<struct<kind:string,start:long,end:long,base:boolean>>")
    def find(texts):  # noqa: ANN001, ANN202 - series of texts, null where there is nothing to find
        import pandas as pd

        out = []
        for text in texts:
            if text is None or not isinstance(text, str):
                out.append([])
                continue
            base = base_spans(text)
            spans = [(k, a, b, True) for k, a, b in base]
            if w:
                for a, b in regions(text):
                    own = [s for s in base if s[1] < b and a < s[2]]
                    for k, x, y in best(Region(text, a, b), w):
                        if all(y <= s[1] or s[2] <= x for s in own):
                            spans.append((k, x, y, False))
            out.append([{"kind": KINDS[k], "start": a, "end": b, "base": o} for k, a, b, o in sorted(spans)])
        return pd.Series(out, dtype=object)

    some = F.col("text").rlike(CANDIDATE)
    return docs.withColumn("spans", F.coalesce(find(F.when(some, F.col("text"))), F.array()))


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii_spans(table(spark, sf_dir, "documents", "doc_id", "text"))
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.array_remove(F.transform(kinds, lambda s: s == F.lit(k)), F.lit(False))).cast("long").alias(f"n_{k}") for k in KINDS]
    joined = F.array_join(F.transform(base, name), ",")
    return out.select(
        "doc_id", *counts, F.sha2(joined.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("spans", name), ",").alias("spans")
    )
