"""Language identification by nearest centroid: TF-IDF n-gram vectors, several clustered centroids per language, cosine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmill.llm.common import crc_remainder, table
from litmill.session import cut_lineage

BITS = 12
DIM = 1 << BITS
ROWS_PER_LANGUAGE = 400
CENTROIDS, ROUNDS = 4, 8
SLACK, HALF = 0.5, 200
CHUNK = 1 << 20
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """1 for each code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Counter:
    """n-gram counts of texts: 2- and 3-grams of letters, other characters as one blank, hashed to DIM places."""

    def __init__(self) -> None:
        self.letters = _letters()

    def __call__(self, texts: list[str]) -> np.ndarray:
        """A row of DIM counts for each text, whole texts; letters are lower-cased."""
        out = np.zeros((len(texts), DIM), np.float32)
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and to - at < 512 and (to == at or size + len(texts[to]) < CHUNK):
                size += len(texts[to])
                to += 1
            low = [t.lower() for t in texts[at:to]]
            code = np.frombuffer((" " + " ".join(low) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
            owner = np.repeat(np.arange(to - at), [len(t) + 1 for t in low])
            owner = np.concatenate([[0], owner, [to - at - 1]])[: len(code)].astype(np.int64)
            x = np.where(self.letters[code], code, 0)
            keep = np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])
            x, owner = x[keep].astype(np.uint64), owner[keep]
            for a in range(0, max(0, len(x) - 2), 4 * CHUNK):
                y = x[a : a + 4 * CHUNK + 2]
                own = owner[a + 1 : a + len(y) - 1]  # the owner of an n-gram's second character
                two = y[:-2] * np.uint64(0x9E3779B97F4A7C15) + y[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
                three = (two ^ (two >> np.uint64(29))) * np.uint64(0x165667B19E3779F9) + y[2:] * np.uint64(0x9E3779B97F4A7C15)
                for grams, some in ((two, (y[:-2] != 0) | (y[1:-1] != 0)), (three, y[1:-1] != 0)):
                    place = ((grams ^ (grams >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
                    flat = own[some] * DIM + place.astype(np.int64)[some]
                    out[at:to] += np.bincount(flat, minlength=(to - at) * DIM).reshape(-1, DIM)
            at = to
        return out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors; a row without n-grams stays zero."""
    v = np.log1p(counts) * idf
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return (v / np.maximum(norm, 1e-12)).astype(np.float32)


def reach(counts: np.ndarray) -> np.ndarray:
    """The part of a centroid that a text can cover: a short text has few n-grams, and so a small cosine to any centroid."""
    n = (counts > 0).sum(1)
    return np.sqrt(n / (n + HALF))


@dataclass
class Model:
    """langs, centroids (row for row), and the least cosine, as a part of ``reach``, that is accepted for each centroid."""

    langs: list[str]
    centroids: np.ndarray
    least: np.ndarray
    idf: np.ndarray


def sample(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """(lang, text) of at most ``rows`` documents of each language, chosen by a hash of the id: the bound of the training set."""
    hashed = docs.where("lang is not null and text is not null").withColumn("_h", F.xxhash64(F.lit(7), "doc_id"))
    n = cut_lineage(hashed.groupBy("lang").agg(F.count("*").alias("_n")))
    # a hash threshold first, so that only about twice the rows that are needed meet in the window
    share = F.lit(2.0 * rows + 50) / F.col("_n")
    near = hashed.join(n, "lang").where((F.pmod("_h", F.lit(1 << 30)) / F.lit(float(1 << 30))) < share)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))
    return near.withColumn("_k", place).where(F.col("_k") <= rows).select("lang", "text")


def fit(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> Model:
    """Centroids from ``docs`` (doc_id, text, lang); rows without a text or language teach nothing.

    The counts of the sampled texts stay on the executors: inverse document frequencies are one array of DIM numbers, and the
    documents of a language, at most ``rows``, are clustered in one task. The model has CENTROIDS x DIM numbers a language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for b in batches:
            c = counter(b.column(1).to_pylist())
            ok = c.any(1)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array([r.tobytes() for r in c[ok]], pa.binary())], ["lang", "counts"])

    seen = cut_lineage(sample(docs, rows).mapInArrow(count, "lang string, counts binary"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            for c in b.column(0):
                df += np.frombuffer(c.as_buffer(), np.float32) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(DIM + 1), pa.int32()), pa.array([*df, n], pa.int64())], ["place", "df"])

    found = seen.select("counts").mapInArrow(frequencies, "place int, df long").groupBy("place").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(DIM + 1)
    for r in found:
        df[r["place"]] = r["df"]
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)

    def cluster(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("counts")  # any order of arrival gives the same centroids
        counts = np.stack([np.frombuffer(c, np.float32) for c in g["counts"]])
        v = vectors(counts, idf)
        at = [int(np.argmax(v @ v.mean(0)))]
        while len(at) < min(CENTROIDS, len(v)):
            at.append(int(np.argmin((v @ v[at].T).max(1))))
        c = v[at]
        for _ in range(ROUNDS):
            own = (v @ c.T).argmax(1)
            c = np.stack([v[own == k].mean(0) if (own == k).any() else c[k] for k in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = (v @ c.T).max(1) / reach(counts)
        return pd.DataFrame({"lang": g["lang"].iloc[0], "centroid": [x.astype(np.float32).tobytes() for x in c], "least": SLACK * float(near.min())})

    rows_ = seen.groupBy("lang").applyInPandas(cluster, "lang string, centroid binary, least double").orderBy("lang", "centroid").collect()
    c = np.stack([np.frombuffer(r["centroid"], np.float32) for r in rows_]) if rows_ else np.zeros((0, DIM), np.float32)
    return Model([r["lang"] for r in rows_], c, np.array([r["least"] for r in rows_]), idf)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text and any others but lang_pred, score, rejected) with those three added.

    lang_pred: the language of the nearest centroid; `und` for null texts and texts without a letter, and where the model knows
    no language. score: the cosine. rejected: nothing near enough (the cosine, as a part of what a text of this length can
    reach, is under SLACK times the least that a training document of that language has) or `und`. Whole texts are read; an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept)
    place = kept.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for b in batches:
            lang: list[str] = []
            score: list[float] = []
            low: list[bool] = []
            for a in range(0, b.num_rows, 256):
                counts = counter([t or "" for t in b.column(place)[a : a + 256].to_pylist()])
                some = counts.any(1)
                if not model.langs:
                    some[:] = False
                    cos = np.zeros((len(counts), 1))
                else:
                    cos = vectors(counts, model.idf) @ model.centroids.T
                best = cos.argmax(1)
                far = reach(counts)
                top = np.clip(cos[np.arange(len(cos)), best], 0, 1).astype(float)
                lang += [model.langs[k] if ok else UNKNOWN for k, ok in zip(best, some, strict=True)]
                score += [float(x) if ok else 0.0 for x, ok in zip(top, some, strict=True)]
                low += [not ok or bool(x < model.least[k] * r) for k, x, r, ok in zip(best, top, far, some, strict=True)]
            cols = [*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, [*kept, "lang_pred", "score", "rejected"])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(predict, f"{schema}, lang_pred string, score double, rejected boolean")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = crc_remainder("doc_id", 3) == 1
    model = fit(docs.where(~held))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
