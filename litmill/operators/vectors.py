"""Vectors: hash embedding, exact nearest neighbours for batches of questions, incremental stores."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions.skew import top_k
from litmill.operators.cells import VectorStore

# Megabytes of float64 in a block of questions, and in a block of vectors or of their scores.
QUESTION_MB = 2
VECTOR_MB = 64


def hash_vector(text: Column, dim: int = 64) -> Column:
    """Unit vector made of the SHA-256 bytes of a text, each mapped to [-1, 1] and repeated to ``dim``."""
    hexa = F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)

    def values(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(31)),
            lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0 * 2 - 1,
        )

    raw = F.slice(F.flatten(F.array_repeat(F.transform(F.array(hexa), values)[0], -(-dim // 32))), 1, dim)

    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(F.array(norm), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)))[0]

    return F.transform(F.array(raw), unit)[0]


def hash_embed(texts: DataFrame, dim: int = 64, text: str = "text", out: str = "embedding") -> DataFrame:
    return texts.withColumn(out, hash_vector(F.col(text), dim))


def embed_with(texts: DataFrame, make_model: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text", out: str = "embedding", batch: int = 32) -> DataFrame:
    """Embeddings by a plugged-in model: loaded once per task, fed in batches, rows scaled to unit length."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for texts_ in batches:
            parts = []
            for i in range(0, len(texts_), batch):
                m = np.asarray(model(texts_.iloc[i : i + batch].tolist()), dtype="float32")
                n = np.linalg.norm(m, axis=1, keepdims=True)
                parts.extend(m / np.where(n > 0, n, 1))
            yield pd.Series(parts)

    return texts.withColumn(out, embed(F.col(text)))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best scores of every row; equal ones by column."""
    n = scores.shape[1]
    cut = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
    row, col = np.nonzero(scores >= cut[:, None])
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _top_columns(left: np.ndarray, right: np.ndarray, k: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and places of the k best rows of ``right`` for every row of ``left``; at most ``cells`` scores are held at once."""
    n, step = min(k, len(right)), max(1, cells // len(left))
    score, col = np.full((len(left), n), -np.inf), np.full((len(left), n), len(right))
    for at in range(0, len(right), step):
        new = np.round(left @ right[at : at + step].T, 9)
        row, c = np.nonzero(new > score[:, -1:])  # equal ones came earlier
        if len(row) > 4 * n * len(left):
            row, c = _best(new, n)
        if not len(row):
            continue
        some = np.unique(row)
        r, s, c = np.concatenate([np.repeat(some, n), row]), np.concatenate([score[some].ravel(), new[row, c]]), np.concatenate([col[some].ravel(), c + at])
        order = np.lexsort((c, -s, r))
        kept = order[np.arange(len(r)) - np.searchsorted(r[order], r[order]) < n]
        score[some], col[some] = s[kept].reshape(-1, n), c[kept].reshape(-1, n)
    return score, col


def _block_top(q: pd.DataFrame, v: pd.DataFrame, k: int, rows: int, cells: int) -> pd.DataFrame:
    """The k best vectors of a block for every question of a block, ``rows`` questions at a time; at most ``cells`` scores are held at once."""
    found = [pd.DataFrame({"query_id": q["query_id"][:0], "chunk_id": v["chunk_id"][:0], "score": np.zeros(0)})]
    v, q = v.sort_values("chunk_id", ignore_index=True), q[q["query_id"].notna()]
    for want, asked in q.groupby("want", dropna=False):
        allowed = v if pd.isna(want) else v[v["kind"] == want]
        if not len(allowed):
            continue
        right, ids = _matrix(allowed["embedding"]), allowed["chunk_id"].to_numpy()
        for at in range(0, len(asked), rows):
            part = asked.iloc[at : at + rows]
            score, col = _top_columns(_matrix(part["embedding"]), right, k, cells)
            row, place = np.nonzero(np.isfinite(score))
            found.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[row], "chunk_id": ids[col[row, place]], "score": score[row, place]}))
    return found[0] if len(found) == 1 else pd.concat(found[1:])


def _blocks(df: DataFrame, mb: float) -> tuple[int, int]:
    """Number of blocks that hold ``mb`` megabytes of vectors each, and the width of a vector."""
    rows, width = df.agg(F.count("*"), F.max(F.size("embedding"))).first()
    return max(1, math.ceil(rows * (width or 0) * 8 / (mb * 2**20))), max(1, width or 0)


def knn(
    queries: DataFrame,
    vectors: DataFrame | VectorStore,
    k: int = 10,
    where: Column | None = None,
    question_mb: float = QUESTION_MB,
    vector_mb: float = VECTOR_MB,
) -> DataFrame:
    """(query_id, chunk_id, score, rank): exact top k by dot product for every question.

    queries: query_id (unique), embedding, optionally want (a chunk type or null); vectors: chunk_id, embedding,
    chunk_type where questions want one. Filters and types apply before any ranking. Null embeddings are left out.
    Both sides are dealt to blocks by hashed id, as many as their rows times their width need, and every block of
    questions meets every block of vectors in one task, which returns k rows per question. Rows are copied once for
    each block of the other side, so blocks smaller than QUESTION_MB and VECTOR_MB are cut inside the task, not
    dealt. Nothing passes through the driver but the four numbers that give the blocks. Scores are compared at nine
    digits, ties by chunk id.
    Stored vectors (``cells``) are searched by their cells instead; ``where`` is for tables alone.
    """
    if isinstance(vectors, VectorStore):
        return vectors.search(queries, k).results
    if where is not None:
        vectors = vectors.where(where)
    text = "string"
    want = F.col("want").cast(text) if "want" in queries.columns else F.lit(None).cast(text)
    kind = F.col("chunk_type").cast(text) if "want" in queries.columns else F.lit(None).cast(text)
    q = queries.where("embedding is not null").select("query_id", "embedding", want.alias("want"))
    v = vectors.where("embedding is not null").select("chunk_id", "embedding", kind.alias("kind"))
    qt, vt = q.schema["query_id"].dataType.simpleString(), v.schema["chunk_id"].dataType.simpleString()

    (q_blocks, width), (v_blocks, _) = _blocks(q, max(question_mb, QUESTION_MB)), _blocks(v, max(vector_mb, VECTOR_MB))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = q.select("*", own("query_id", q_blocks).alias("qb"), every(v_blocks).alias("vb"))
    right = v.select("*", own("chunk_id", v_blocks).alias("vb"), every(q_blocks).alias("qb"))
    rows, cells = max(1, int(question_mb * 2**17 / width)), int(vector_mb * 2**17)

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _block_top(a, b, k, rows, cells)

    partial = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(pair, f"query_id {qt}, chunk_id {vt}, score double")
    return top_k(partial, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)


def upsert_vectors(store: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The rows of ``chunks`` whose id the store lacks, one per id: what an append has to write."""
    new = chunks.join(store.select(key).distinct(), key, "left_anti")
    return new.dropDuplicates([key])
