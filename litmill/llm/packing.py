"""Best-fit packing planned on the histogram of lengths.

Only longer documents are cut. The plan sees counts per length (at most ``size`` of them): from the longest down, all
pieces of a length go to the tightest open sequences as whole groups of like sequences. A planned slot is a range of
ranks within a length; each piece takes the slot of its rank by a join.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmill.llm.common import release, table
from litmill.session import cut_lineage

SIZE = 2048
END = 0
KNOWN_WORDS, KNOWN_LENGTH = 1_000_000, 40
SLOTS = "length long, rank_from long, rank_to long, sequence_from long, per_sequence long, offset_from long"


def word_file() -> str:
    """The vocabulary file of the registered query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Ids:
    """Token ids of whole texts as little-endian 32-bit bytes.

    The tokenizer lower-cases, and cuts at white space, which it drops, and between letters and signs. So a text's ids are those
    of its blank-separated parts, one after another, and those of a part of letters with a full stop or comma are the
    letters' and the sign's. Ids of short parts are kept in a table of bounded size; a full one stays as the older table,
    from which parts that come again are taken over. New parts are encoded together; the offsets tell whose ids they are.
    """

    def __init__(self, path: str, known_words: int = KNOWN_WORDS):
        self.most = known_words
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _encoded(self, parts: list[bytes]) -> dict[bytes, bytes]:
        out = {}
        for at in range(0, len(parts), 20_000):
            some = [p.decode() for p in parts[at : at + 20_000]]
            e = self.of.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(e.ids, "<u4").tobytes()
            starts = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))
            size = np.fromiter(map(len, some), np.int64, len(some)) + 1
            edges = (4 * np.searchsorted(starts, np.concatenate([[0], np.cumsum(size)]))).tolist()
            for p, a, b in zip(parts[at : at + 20_000], edges[:-1], edges[1:], strict=True):
                out[p] = ids[a:b]
        return out

    def _new(self, parts: list[bytes]) -> dict[bytes, bytes]:
        whole, signed = {}, []
        for p in parts:
            if p[-1:] in (b".", b",") and p[:-1].decode().lower().isalpha():  # lower case may end in a mark
                signed.append(p)
                whole[p[:-1]] = whole[p[-1:]] = None
            else:
                whole[p] = None
        out = {p: ids for p in whole if (ids := self.known.get(p, self.older.get(p))) is not None}
        out |= self._encoded([p for p in whole if p not in out])
        for p in signed:
            out[p] = out[p[:-1]] + out[p[-1:]]
        return out

    def __call__(self, text: str) -> bytes:
        raw = text.encode()
        if b"<|" not in raw:  # special tokens are told by their case
            raw = raw.lower()
        parts = raw.replace(b"\n", b" ").split(b" ")
        try:
            return b"".join(map(self.known.__getitem__, parts))
        except KeyError:
            missing = [p for p in dict.fromkeys(parts) if p not in self.known]
            new = {p: self.older[p] for p in missing if p in self.older}
            new |= self._new([p for p in missing if p not in new])
            ids = b"".join([self.known[p] if p in self.known else new[p] for p in parts])
            if len(self.known) + len(new) > self.most:
                self.known, self.older = {}, self.known
            self.known.update((p, v) for p, v in new.items() if len(p) <= KNOWN_LENGTH)
            return ids


@lru_cache(maxsize=1)
def ids_of(path: str, known_words: int) -> Ids:
    """One for each Python worker, so that a task finds the words of the tasks before it."""
    return Ids(path, known_words)


def pieces(docs: DataFrame, path: str, size: int = SIZE, with_ids: bool = True, known_words: int = KNOWN_WORDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids and one id 0, cut every ``size``.

    ``ids``: little-endian 32-bit. Null and empty texts give the id 0 alone. A Python worker keeps the ids of at most twice
    ``known_words`` words, about 150 bytes each.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(path, known_words)
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                flat = ids(text.as_py() or "") + END.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(flat), 4 * size)):
                    part = flat[at : at + 4 * size]
                    for c, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else b""), strict=True):
                        out[c].append(v)
            types = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, ...]]:
    """Slots for ``counts`` pieces by length, as rows of SLOTS: best-fit decreasing, over counts.

    Like sequences are kept as ranges. A group of sequences with room r takes r // length pieces each; only the last
    group that a length reaches is split. There are at most three new groups for a length and each group halves its room
    when it takes a length, so the slots number at most 3 x size x log2(size) whatever the counts are.
    """
    slots, room, open_, n = [], [], {}, 0  # open_: by room, [first sequence, count]
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def put(first: int, number: int, r: int, each: int) -> None:
            nonlocal rank, left
            slots.append((length, rank, rank + number * each, first, each, size - r))
            rank, left = rank + number * each, left - number * each
            if (rest := r - each * length) > 0:
                if rest not in open_:
                    insort(room, rest)
                open_.setdefault(rest, []).append((first, number))

        while left:
            k = bisect_left(room, length)
            if k < len(room):
                r = room[k]
                first, number = open_[r].pop()
                if not open_[r]:
                    del open_[r], room[k]
            else:
                r, first, number = size, n, -(-left // (size // length))
                n += number
            each = r // length
            whole = min(number, left // each)
            if whole:
                put(first, whole, r, each)
            if whole < number:
                first, number = first + whole, number - whole
                if left:
                    put(first, 1, r, left)
                    first, number = first + 1, number - 1
                if number:
                    if r not in open_:
                        insort(room, r)
                    open_.setdefault(r, []).append((first, number))
    return slots


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length and any others); names with "_" in front are taken.

    ``cut`` must give the same rows whenever it is read (a table). A sequence holds at most ``size`` tokens without gaps.
    Rows that repeat get places of their own; no rows give no rows. Pieces of one length, of which there may be any number,
    are ranked in salted shares, so none is ranked in one task.
    """
    spark = cut.sparkSession
    rows = cut.withColumn("_share", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))))
    # lengths are at most `size`, so this table and the plan have a bounded number of rows at any scale of data
    shares = cut_lineage(rows.groupBy("length", "_share").agg(F.count("*").alias("_n")))
    counts = {r["length"]: r["n"] for r in shares.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shares.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = Window.partitionBy("length", "_share").orderBy("doc_id", "piece")
    ranked = rows.join(offsets, ["length", "_share"]).withColumn("_rank", F.col("_before") + F.row_number().over(place) - 1)
    slots = F.broadcast(spark.createDataFrame(plan(counts, size), SLOTS).withColumnRenamed("length", "_length"))
    on = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to"))
    k = F.col("_rank") - F.col("rank_from")
    out = ranked.join(slots, on).withColumns(
        {
            "sequence_id": F.col("sequence_from") + F.floor(k / F.col("per_sequence")),
            "offset": F.col("offset_from") + k % F.col("per_sequence") * F.col("length"),
        }
    )
    return out.select(*cut.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SIZE, known_words: int = KNOWN_WORDS) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text; others are ignored) with their places, without the ids themselves."""
    return pack(cut_lineage(pieces(docs, path or word_file(), size, False, known_words)), size)


def op9_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
