"""Bounded-space online packing.

Each task keeps a fixed number of open windows and reads its documents once. A document goes to the window that it fills best;
when none fits, the fullest window takes the document's head, is emitted full, and the rest opens a new window. What stays open
at the end of a task is merged into one window at most; those windows are merged by the same rule, some hundred at a time, until
one is left, which is cut into sequences of powers of two.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.llm.common import release, table
from litmill.llm.packing import KNOWN_WORDS, ids_of, word_file
from litmill.session import cut_lineage

SIZE, END = 2048, 1
OPEN_WINDOWS = 64
MERGED = 256
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
ROUND, GROUP = 1 << 56, 1 << 32  # a sequence's number: round of merging, task or group in it, place there

Piece = tuple  # document, start, ids (little-endian 32-bit), tokens of the document


def cut(piece: Piece, n: int) -> tuple[Piece, Piece]:
    """The first ``n`` tokens and the rest."""
    doc, start, ids, tokens = piece
    return (doc, start, ids[: 4 * n], tokens), (doc, start + n, ids[4 * n :], tokens)


class Windows:
    """At most ``most`` open windows of ``size`` tokens; ``emitted`` holds finished ones until they are taken.

    ``max_padding``: a window with no more room than that is emitted as it is, without a document's head.
    """

    def __init__(self, size: int, most: int, max_padding: int = 0):
        self.size, self.most, self.max_padding = size, most, max_padding
        self.rooms: list[tuple[int, int]] = []  # room and number of each open window, sorted
        self.open: dict[int, list[Piece]] = {}
        self.emitted: list[list[Piece]] = []
        self.number = 0

    def put(self, piece: Piece) -> None:
        """Places a piece of any length, longer ones in whole windows first."""
        while (n := len(piece[2]) // 4) >= self.size:
            head, piece = cut(piece, self.size)
            self.emitted.append([head])
        if not n:
            return
        k = bisect_left(self.rooms, (n, -1))
        if k < len(self.rooms):
            room, number = self.rooms.pop(k)
            self._add(number, room, piece)
        elif len(self.rooms) < self.most:
            self._new(piece)
        else:
            room, number = self.rooms.pop(0)
            if room > self.max_padding:
                head, piece = cut(piece, room)
                self.open[number].append(head)
            self.emitted.append(self.open.pop(number))
            self._new(piece)

    def _new(self, piece: Piece) -> None:
        self.number += 1
        self.open[self.number] = []
        self._add(self.number, self.size, piece)

    def _add(self, number: int, room: int, piece: Piece) -> None:
        self.open[number].append(piece)
        if room := room - len(piece[2]) // 4:
            insort(self.rooms, (room, number))
        else:
            self.emitted.append(self.open.pop(number))

    def merge(self) -> list[Piece]:
        """Fills the fullest windows from the emptiest; the pieces of the one that isn't full, if any, are returned."""
        left = []
        for room, number in self.rooms:
            pieces = self.open.pop(number)
            (self.emitted if room <= self.max_padding else left).append(pieces if room <= self.max_padding else [room, pieces])
        while len(left) > 1:
            room, pieces = left[0]
            head, rest = cut(left[-1][1].pop(), room)
            pieces.append(head)
            left[0][0] -= len(head[2]) // 4
            if rest[2]:
                left[-1][1].append(rest)
            if not left[0][0]:
                self.emitted.append(left.pop(0)[1])
            if left and not left[-1][1]:
                left.pop()
        self.rooms = []
        return left[0][1] if left else []


def halves(pieces: list[Piece], size: int) -> list[list[Piece]]:
    """The pieces cut into sequences whose lengths are falling powers of two."""
    out, left = [], sum(len(p[2]) for p in pieces) // 4
    pieces = pieces[::-1]
    while left:
        room = min(1 << (left.bit_length() - 1), size)
        left, one = left - room, []
        while room:
            head, rest = cut(pieces.pop(), room)
            one.append(head)
            room -= len(head[2]) // 4
            if rest[2]:
                pieces.append(rest)
        out.append(one)
    return out


def rows_of(sequences: list[list[Piece]], first: int, with_ids: bool) -> list[tuple]:
    """Rows as NAMES, the sequences numbered from ``first``."""
    out = []
    for k, pieces in enumerate(sequences):
        at = 0
        for doc, start, ids, tokens in pieces:
            n = len(ids) // 4
            out.append((doc, start, n, zlib.crc32(ids), tokens, first + k, at, ids if with_ids else None))
            at += n
    return out


def batch_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, *[pa.int64()] * 6, pa.binary()]
    columns = zip(*rows, strict=True) if rows else [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], NAMES)


def schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in NAMES[1:-1]) + ", ids binary"


def online(docs: DataFrame, path: str, size: int, open_windows: int, max_padding: int, known_words: int) -> DataFrame:
    """Rows as NAMES; those of the one window that a task leaves open have ``ids``, the others null."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, windows = ids_of(path, known_words), Windows(size, open_windows, max_padding)
        number, kind = TaskContext.get().partitionId() * GROUP, pa.int64()
        for b in batches:
            kind = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                flat = ids(text.as_py() or "") + END.to_bytes(4, "little")
                windows.put((doc, 0, flat, len(flat) // 4))
            yield batch_of(rows_of(windows.emitted, number, False), kind)
            number, windows.emitted = number + len(windows.emitted), []
        left = windows.merge()
        yield batch_of(rows_of(windows.emitted, number, False) + rows_of([left], number + len(windows.emitted), True), kind)
        release()

    return docs.select("doc_id", "text").mapInArrow(placed, schema(docs))


def merged(left: DataFrame, k: int, groups: int, size: int, open_windows: int, max_padding: int) -> DataFrame:
    """Open windows dealt to ``groups`` and merged in each; the last group of all is cut into powers of two."""

    def merge(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        kind = rows.schema.field("doc_id").type
        rows = rows.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        windows = Windows(size, open_windows, max_padding)
        for p in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
            windows.put(p)
        rest, first = windows.merge(), k * ROUND + key[0].as_py() * GROUP
        if groups == 1:
            return pa.Table.from_batches([batch_of(rows_of(windows.emitted + halves(rest, size), first, False), kind)])
        out = rows_of(windows.emitted, first, False) + rows_of([rest], first + len(windows.emitted), True)
        return pa.Table.from_batches([batch_of(out, kind)])

    group = F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).alias("_group")
    return left.groupBy(group).applyInArrow(merge, schema(left))


def bounded_pack(
    docs: DataFrame, path: str | None = None, size: int = SIZE, open_windows: int = OPEN_WINDOWS, max_padding: int = 0, known_words: int = KNOWN_WORDS
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text; others are ignored) with sequence_id and offset.

    A document is its ids and one id 1. Null and empty texts are that id alone; rows that repeat and null ids are documents of
    their own; an empty table gives no rows. A task holds ``open_windows`` windows and one document at a time, whatever the
    table's size; a merging group holds some MERGED windows. With ``max_padding`` 0 no sequence is padded: all but the last few
    are full, and those are powers of two. Which documents share a sequence depends on how the rows are dealt; the table is written once.
    """
    out = cut_lineage(online(docs, path or word_file(), size, open_windows, max_padding, known_words))
    done, left, k = [out.where(F.col("ids").isNull())], out.where(F.col("ids").isNotNull()), 0
    windows = left.select(F.count_distinct("sequence_id")).first()[0]
    while windows:
        k, groups = k + 1, -(-windows // MERGED)
        out = cut_lineage(merged(left, k, groups, size, open_windows, max_padding))
        done.append(out.where(F.col("ids").isNull()))
        left, windows = out.where(F.col("ids").isNotNull()), groups if groups > 1 else 0
    packed = done[0]
    for d in done[1:]:
        packed = packed.unionByName(d)
    return packed.drop("ids")


def op12_bounded_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded_pack(table(spark, sf_dir, "documents", "doc_id", "text"))
