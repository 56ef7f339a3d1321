"""Lines that several documents share, through a sharded minimal perfect hash.

Distinct line hashes are dealt to shards. In each shard a minimal perfect hash gives every hash a place of its own in
compact arrays: fingerprint, number of documents, smallest document. Documents send the hashes of their lines, once per
batch of documents, to the shards, which look them up in the arrays; lines themselves are never joined.
"""

from __future__ import annotations

import secrets
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.llm.common import BLANKS, free_names, release, table
from litmill.session import cut_lineage

MIN_POINTS = 10
SHARD_KEYS = 50_000
GAMMA, LEVELS = 1.5, 64
NO_ID = np.iinfo(np.int64).max

KEYS = "batch long, h1 long, h2 long, lo long, hi long, n int, refs binary"
INDEX = "shard long, sizes binary, bits binary, fingerprints binary, counts binary, firsts binary"


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    """Another hash of the same keys for each level (the 64-bit finaliser of MurmurHash3; its two factors are fixed)."""
    x = h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: a bit array for each level, and the rank of a key's bit as its place.

    At each level a key that meets no other at its position sets the bit; the others go on to the next level.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        for level in range(LEVELS):
            if not len(keys):
                break
            size = max(64, int(GAMMA * len(keys)))
            at = (_mixed(keys, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            keys = keys[~alone[at]]
        if len(keys):
            raise ValueError("keys are not distinct")
        return cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool))

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, from 0; any place or -1 for other keys."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + (_mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            out[left[hit]] = self.ranks[at[hit]]
            left = left[~hit]
        return out


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def long_enough(key: bytes, points: int = MIN_POINTS) -> bool:
    return len(key) >= points and (len(key) >= 4 * points or len(key.decode()) >= points)


def line_keys(rows: DataFrame, points: int = MIN_POINTS) -> DataFrame:
    """KEYS of ``rows`` (id, mark, text): one row per Arrow batch of documents and line hash.

    lo, hi: smallest and largest id that holds the line; n: documents; refs: (id, mark, line number) of every such line.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = struct.Struct("<qqq").pack
        for b in batches:
            found: dict[bytes, list] = {}
            for k, (own, mark, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)):
                for at, line in enumerate((text.as_py() or "").encode().split(b"\n")):
                    key = line_key(line)
                    if not long_enough(key, points):
                        continue
                    ref, h = pack(own, mark, at), xxhash.xxh3_128_digest(key)
                    if (seen := found.get(h)) is None:
                        found[h] = [own, own, 1, k, [ref]]
                        continue
                    seen[4].append(ref)
                    if seen[3] != k:
                        seen[:4] = min(seen[0], own), max(seen[1], own), seen[2] + 1, k
            if not found:
                continue
            h = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            lo, hi, n, _, refs = zip(*found.values(), strict=True)
            name = secrets.randbits(63)  # the table is written once, so a name stays as it is
            columns = [np.full(len(h), name, np.int64), h[:, 0], h[:, 1], pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(n, pa.int32())]
            columns.append(pa.array([b"".join(r) for r in refs], pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["batch", "h1", "h2", "lo", "hi", "n", "refs"])
            del found, columns, refs
        release()

    return rows.select("id", "mark", "text").mapInArrow(hashed, KEYS)


def build_index(keys: DataFrame, shards: int) -> DataFrame:
    """INDEX over the distinct hashes of ``keys``, one row per shard; a shard has about SHARD_KEYS of them."""
    distinct = keys.groupBy("h1", "h2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    dealt = distinct.withColumn("shard", F.pmod("h2", F.lit(shards)))

    def arrays(t: pa.Table) -> pa.Table:
        h1, h2, lo, hi, n = (t.column(c).to_numpy() for c in ("h1", "h2", "lo", "hi", "n"))
        key = h1.view(np.uint64) ^ _mixed(h2.view(np.uint64), LEVELS)
        ph = PerfectHash.build(key)
        order = np.argsort(ph.places(key))
        count = np.where(lo < hi, np.clip(n, 2, 2**32 - 1), 1)
        row = [t.column("shard")[0].as_py(), ph.sizes.tobytes(), np.packbits(ph.bits).tobytes(), h1[order].astype("<i8").astype("<u4").tobytes(), count[order].astype("<u4").tobytes(), lo[order].astype("<i8").tobytes()]
        names = ["shard", "sizes", "bits", "fingerprints", "counts", "firsts"]
        return pa.table({k: pa.array([v], pa.int64() if k == "shard" else pa.binary()) for k, v in zip(names, row, strict=True)})

    return dealt.groupBy("shard").applyInArrow(arrays, INDEX)


def probe(keys: DataFrame, index: DataFrame, shards: int, min_docs: int = 2) -> DataFrame:
    """(batch, h1, h2, first) of those ``keys`` that the arrays give at least ``min_docs`` documents."""
    asked = keys.select("batch", "h1", "h2", F.pmod("h2", F.lit(shards)).alias("shard"))

    def look(asked: pa.Table, index: pa.Table) -> pa.Table:
        h1, h2 = (asked.column(c).to_numpy() for c in ("h1", "h2"))
        row = {c: index.column(c)[0].as_py() for c in index.column_names} if index.num_rows else None
        if row is None:
            return asked.select(["batch", "h1", "h2"]).append_column("first", asked.column("h1")).slice(0, 0)
        sizes = np.frombuffer(row["sizes"], np.int64)
        ph = PerfectHash(sizes, np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum())).astype(bool))
        prints, counts, firsts = (np.frombuffer(row[c], k) for c, k in (("fingerprints", "<u4"), ("counts", "<u4"), ("firsts", "<i8")))
        at = ph.places(h1.view(np.uint64) ^ _mixed(h2.view(np.uint64), LEVELS))
        hit = (at >= 0) & (prints[at] == h1.astype("<u4")) & (counts[at] >= min_docs)
        out = asked.select(["batch", "h1", "h2"]).filter(pa.array(hit))
        return out.append_column("first", pa.array(firsts[at[hit]], pa.int64()))

    return asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(look, "batch long, h1 long, h2 long, first long")


def dropped_lines(rows: DataFrame, points: int = MIN_POINTS) -> DataFrame:
    """(id, mark, lines): the numbers of the lines that each of ``rows`` (id, mark, text) loses; rows that lose none are left out."""
    keys = cut_lineage(line_keys(rows, points))
    shards = max(1, -(-keys.count() // SHARD_KEYS))
    index = cut_lineage(build_index(keys, shards))
    found = probe(keys, index, shards)

    def losing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            refs = [np.frombuffer(r.as_buffer(), "<i8").reshape(-1, 3) for r in b.column(0)]
            if refs:
                flat = np.concatenate(refs)
                flat = flat[flat[:, 0] != np.repeat(b.column(1).to_numpy(), [len(r) for r in refs])]
                yield pa.RecordBatch.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["id", "mark", "line"])

    # every (batch, hash) is one row on both sides, so no line is a hot key here
    at = keys.select("batch", "h1", "h2", "refs").join(found, ["batch", "h1", "h2"]).select("refs", "first")
    lost = at.mapInArrow(losing, "id long, mark long, line long")
    return lost.groupBy("id", "mark").agg(F.collect_list(F.col("line").cast("int")).alias("lines"))


def line_dedup(docs: DataFrame, points: int = MIN_POINTS) -> DataFrame:
    """``docs`` (doc_id, text and any others) with ``text`` cut, n_lines (before) and n_dropped added.

    A line's key is the line without ASCII blanks at its ends, A-Z lower-cased. Keys of at least ``points`` code points that
    at least two doc_ids hold lose all their lines but those in the smallest doc_id that holds them. Null and empty texts are
    one empty line, and come back empty. Rows that repeat a doc_id are one document to this rule. A null doc_id comes after
    all others; ids are numbers. An empty table gives an empty table. Other columns stay as they are, whatever their names;
    those named n_lines and n_dropped are replaced.
    """
    own, mark, gone = free_names(docs, "_id", "_mark", "_lines")
    # a row is known by its id and the hash of its text: rows that repeat both lose the same lines
    rows = docs.withColumns({own: F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))), mark: F.xxhash64("text")})
    lost = dropped_lines(rows.select(F.col(own).alias("id"), F.col(mark).alias("mark"), "text"), points)
    lost = lost.select(F.col("id").alias(own), F.col("mark").alias(mark), F.col("lines").alias(gone))
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(at, lambda i: lines[i]), "\n"))
    n = F.size(lines).cast("long")
    dropped = F.coalesce(F.size(F.array_distinct(F.col(gone))), F.lit(0)).cast("long")
    others = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return rows.join(lost, [own, mark], "left").select(
        *[(kept.alias(c) if c == "text" else F.col(c)) for c in others], n.alias("n_lines"), dropped.alias("n_dropped")
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL_OP6 = r"""with l as (
  select doc_id, k, string_split(coalesce(text, ''), chr(10))[k] as line from
    (select doc_id, text, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) as k from documents)),
m as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
g as (select key, min(doc_id) as first from m where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
f as (select m.*, g.first is null or g.first = m.doc_id as stays from m left join g using (key))
select doc_id, count(*) as n_lines, count(*) filter (not stays) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by k) filter (stays), '')) as kept_sha256
from f group by doc_id"""
