"""Phrases that stand together more often than their parts let expect, mined level by level in sorted relations.

The occurrences of a block of pieces are a relation sorted by piece and position: an array whose index is the place (a border
takes one between two pieces) and whose value is the word's number, or -1. Joining a relation with itself at adjacent places
gives the next level: a phrase of k + 1 words is its first and its last k words at two places in a row. Each level's
groups are counted in their block, summed over all blocks, and those that are frequent go back to their blocks, where the
relation is semi-joined with them before it is extended. No part of a frequent phrase is rarer, so none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmill.llm.common import LOWER, UPPER, release, table
from litmill.session import cut_lineage

MIN_COUNT, MAX_WORDS, TOP = 10, 3, 2000
KEEP_SHARE = 50  # per cent of a phrase's occurrences in a longer one, from which on the longer one stands for it
UNKNOWN = "und"
PLACES = 400_000  # of a block, about
BORDER = b"."
#: Bytes of a text: A-Z in lower case, what parts pieces as BORDER, the two blanks as one.
BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else BORDER[0] if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c for c in range(256))
LOCAL, SEQUENCE = 1 << 27, 1 << 16  # groups of a block, blocks of a task

OCCURRENCES = "block long, lang string, places array<int>, total long, words array<string>, counts array<long>"
JOINED = "block long, places array<int>, first array<long>, second array<long>, counts array<long>"
PAIRS = "first long, second long, n long"


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens(text: str | None) -> list[bytes]:
    """The words of a text and its borders, one at the end."""
    return (text or "").encode().translate(BYTES).replace(BORDER, b" . ").split() + [BORDER]


def lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


def occurrences(docs: DataFrame) -> DataFrame:
    """OCCURRENCES: one row for each block and language, with its distinct words and their counts."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        block, size = TaskContext.get().partitionId() * SEQUENCE, 0

        def emitted() -> Iterator[pa.RecordBatch]:
            nonlocal block
            for lang, (numbers, parts) in held.items():
                places = np.concatenate(parts) - 1  # the border has number 0
                counts = np.bincount(places[places >= 0], minlength=len(numbers) - 1).astype(np.int64)
                words = pa.array(list(numbers)[1:], pa.binary()).cast(pa.string())
                words = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
                columns = [pa.array([block], pa.int64()), pa.array([lang], pa.string()), lists(places), pa.array([counts.sum()], pa.int64()), words, lists(counts)]
                yield pa.RecordBatch.from_arrays(columns, ["block", "lang", "places", "total", "words", "counts"])
                block += 1
            held.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = tokens(text.as_py())
                numbers, parts = held.setdefault(UNKNOWN if lang is None else lang, (Numbers({BORDER: 0}), []))
                parts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                size += len(found)
                if size >= PLACES:
                    yield from emitted()
                    size = 0
        yield from emitted()
        release()

    return docs.select("lang", "text").mapInArrow(blocks, OCCURRENCES)


def frequent(rows: DataFrame, keys: list[str], min_count: int) -> DataFrame:
    """The rows (block, local, n and ``keys``) of frequent groups, with f, the group's count, and id, its number.

    A group is numbered by the least of its (block, local), so that one of its rows names it. A block has one row for each of its
    groups, so the rows of a group are at most as many as the blocks.
    """
    w = Window.partitionBy(*keys)
    named = rows.withColumn("_name", F.col("block") * LOCAL + F.col("local"))
    out = named.withColumns({"f": F.sum("n").over(w), "id": F.min("_name").over(w)}).where(F.col("f") >= min_count)
    return cut_lineage(out.select("block", "local", *keys, "f", "id", (F.col("_name") == F.col("id")).alias("names")))


def joined(relation: DataFrame, groups: DataFrame, last: bool) -> DataFrame:
    """The relation, semi-joined with its frequent ``groups``, joined with itself at the next place.

    JOINED, one row for each block; PAIRS, counted by block, where no level follows.
    """

    def adjacent(relation: pa.Table, groups: pa.Table) -> pa.Table:
        if relation.num_rows and groups.num_rows:
            places = relation.column("places").combine_chunks().flatten().to_numpy()
            local, ids = groups.column("local").to_numpy(), groups.column("id").to_numpy()
            kept = np.full(max(places.max(), local.max()) + 2, -1, np.int64)  # -1, a border or a rare group, finds the last
            kept[local] = np.arange(len(local))
            x = kept[places]
            both = (x[:-1] >= 0) & (x[1:] >= 0)
            found, at, n = np.unique(x[:-1][both] * len(ids) + x[1:][both], return_inverse=True, return_counts=True)
            first, second = ids[found // len(ids)], ids[found % len(ids)]
        else:
            both, at, n, first, second = (np.zeros(0, t) for t in (bool, np.int64, np.int64, np.int64, np.int64))
        if last:
            return pa.table({"first": first, "second": second, "n": n.astype(np.int64)})
        joined = np.full(len(both), -1, np.int32)
        joined[both] = at
        block = relation.column("block").to_pylist()
        columns = [pa.array(block, pa.int64()), *map(lists, (joined, first, second, n.astype(np.int64)))]
        return pa.Table.from_arrays(columns if block else [c.slice(0, 0) for c in columns], ["block", "places", "first", "second", "counts"])

    both = relation.select("block", "places").groupBy("block").cogroup(groups.select("block", "local", "id").groupBy("block"))
    return both.applyInArrow(adjacent, PAIRS if last else JOINED)


def levels(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) and the frequent phrases of 1, 2, ... ``max_words`` words: (id, lang, word, f), then (id, first, second, f)."""
    relation = cut_lineage(occurrences(docs))
    total = cut_lineage(relation.groupBy("lang").agg(F.sum("total").alias("n")))
    each = relation.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "_g"))
    rows, keys, out = each.select("block", "lang", "local", F.col("_g.words").alias("word"), F.col("_g.counts").alias("n")), ["lang", "word"], []
    for k in range(1, max_words + 1):
        groups = frequent(rows, keys, min_count)
        out.append(groups.where("names").select("id", *keys, "f"))
        if k + 1 >= max_words:
            break
        relation, keys = cut_lineage(joined(relation, groups, False)), ["first", "second"]
        each = relation.select("block", F.posexplode(F.arrays_zip("first", "second", "counts")).alias("local", "_g"))
        rows = each.select("block", "local", "_g.first", "_g.second", F.col("_g.counts").alias("n"))
    if max_words > 1:
        counts = joined(relation, groups, True).groupBy("first", "second").agg(F.sum("n").alias("f"))
        counts = counts.where(F.col("f") >= min_count).withColumn("id", F.monotonically_increasing_id())
        out.append(cut_lineage(counts.select("id", "first", "second", "f")))
    return total, out


def described(found: list[DataFrame]) -> Iterator[DataFrame]:
    """The levels from 2 on, each row with lang, words (ids), lefts and rights (counts of its first 1, 2, ... words, and of the
    rest), and the counts of the two shorter phrases in it."""
    none = F.array().cast("array<long>")
    below = found[0].select("id", "lang", "f", F.array("id").alias("words"), none.alias("lefts"), none.alias("rights"))
    for level in found[1:]:
        first = below.select(F.col("id").alias("first"), "lang", F.col("f").alias("first_f"), F.col("words").alias("_words"), F.col("lefts").alias("_lefts"))
        second = below.select(F.col("id").alias("second"), F.col("f").alias("second_f"), F.element_at("words", -1).alias("_word"), F.col("rights").alias("_rights"))
        both = level.join(first, "first").join(second, "second")
        below = cut_lineage(
            both.select(
                "id", "lang", "f", "first", "first_f", "second", "second_f",
                F.concat("_words", F.array("_word")).alias("words"),
                F.concat("_lefts", F.array("first_f")).alias("lefts"),
                F.concat(F.array("second_f"), "_rights").alias("rights"),
            )
        )
        yield below


def weakest_cut(count: Column) -> Column:
    """(score, cut, l, r) of the cut with the lowest score floor(10^6 a^2 / (l r)), the first of equal ones; exact below 10^16."""
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    up = whole(count, 15) * whole(count, 15) * F.lit(1_000_000)

    def cut(k: Column) -> Column:
        left, right = F.element_at("lefts", k), F.element_at("rights", k)
        score = F.call_function("div", up, whole(left, 18) * whole(right, 18))
        return F.struct(score.alias("score"), k.alias("cut"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size("lefts")), cut))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, keep_share: int = KEEP_SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of ``docs`` (lang, text; others are ignored): each language's ``top`` phrases.

    A phrase has 2 to ``max_words`` words of one piece and occurs ``min_count`` times or more, overlaps included. It is dropped if
    a longer one with at least ``keep_share`` per cent of its count holds it; one that is longer by one word decides, as those in
    between are no rarer. Null texts are empty, a null language is `und`. Ties go by count, then phrase in byte order. Rows that
    repeat count as often as they come; an empty table gives no rows. Words are kept whole whatever their length.
    """
    total, found = levels(docs, min_count, max_words)
    parts, phrases = list(described(found)), []
    for k, level in enumerate(parts):
        if k + 1 < len(parts):
            longer = parts[k + 1]
            holds = lambda side: F.col("f") * 100 >= F.col(f"{side}_f") * keep_share
            held = longer.where(holds("first")).select(F.col("first").alias("id")).unionAll(longer.where(holds("second")).select("second"))
            level = level.join(held.distinct(), "id", "left_anti")
        phrases.append(level.select("lang", F.col("f").alias("a"), "words", weakest_cut(F.col("f")).alias("_cut")))
    every = phrases[0]
    for p in phrases[1:]:
        every = every.unionAll(p)
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    every = every.select("lang", "a", "words", F.col("_cut.score").alias("score"), F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"))
    # the words of a phrase are fetched for those alone that may be among the first: all that tie with the last one too
    every = cut_lineage(every.withColumn("_r", F.rank().over(best)).where(F.col("_r") <= top).drop("_r"))
    word = found[0].select(F.col("id").alias("_id"), "word")
    spelt = every.select("words", F.posexplode("words").alias("_at", "_id")).join(word, "_id").groupBy("words")
    spelt = spelt.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = every.join(spelt, "words").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")))
    out = ranked.where(F.col("rank") <= top).join(total, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents", "lang", "text"))


SQL_OP11 = rf"""with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as text from documents),
p as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
o as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w),
t as (select lang, count(*) as n from o group by lang),
f1 as (select lang, ws[i] as x, count(*) as f from o group by all),
f2 as (select lang, ws[i] as x, ws[i + 1] as y, count(*) as f from o where i < len(ws) group by all having count(*) >= 10),
f3 as (select lang, ws[i] as x, ws[i + 1] as y, ws[i + 2] as z, count(*) as f from o where i + 1 < len(ws) group by all having count(*) >= 10),
c2 as (select f2.lang, f2.x || ' ' || f2.y as phrase, f2.f as a, l.f as l, r.f as r, (1000000::hugeint * f2.f * f2.f) // (l.f::hugeint * r.f) as score
  from f2 join f1 l on l.lang = f2.lang and l.x = f2.x join f1 r on r.lang = f2.lang and r.x = f2.y
  where not exists (select 1 from f3 h where h.lang = f2.lang and 100 * h.f >= 50 * f2.f
    and ((h.x = f2.x and h.y = f2.y) or (h.y = f2.x and h.z = f2.y)))),
k3 as (select f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z as phrase, f3.f as a, l1.f as l1, r1.f as r1, l2.f as l2, r2.f as r2,
    (1000000::hugeint * f3.f * f3.f) // (l1.f::hugeint * r1.f) as s1, (1000000::hugeint * f3.f * f3.f) // (l2.f::hugeint * r2.f) as s2
  from f3 join f1 l1 on l1.lang = f3.lang and l1.x = f3.x join f2 r1 on r1.lang = f3.lang and r1.x = f3.y and r1.y = f3.z
    join f2 l2 on l2.lang = f3.lang and l2.x = f3.x and l2.y = f3.y join f1 r2 on r2.lang = f3.lang and r2.x = f3.z),
c as (select * from c2 union all
  select lang, phrase, a, if(s1 <= s2, l1, l2), if(s1 <= s2, r1, r2), least(s1, s2) from k3),
r as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from c)
select lang, rank, phrase, a, l, r.r as r, t.n as n, score::bigint as score from r join t using (lang) where rank <= 2000"""
