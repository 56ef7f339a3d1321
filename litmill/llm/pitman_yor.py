"""Hierarchical Pitman-Yor language model: the context of a word is the word before it.

Each word is a restaurant for the words after it; all share one parent, the word restaurant, whose base is uniform. A customer that
opens a table in a context becomes a customer of the parent. Words seen fewer than MIN_COUNT times, and unknown ones, are one dish
and one context, RARE, within which a word has its smoothed share; so contexts and dishes grow with the corpus. A text starts in
the restaurant of the end (the empty word).

A Gibbs sweep removes all customers of a dish from a context, its tables from the parent too, and seats them anew one after
another, given the other dishes' seats of the sweep before; draws are hashes of (context, dish, sweep, customer), so they don't
depend on how rows are dealt. Texts are scored by predictive probabilities averaged over the sweeps after the first ones.

Texts are read once, into blocks of word numbers. A block sends each of its distinct words and pairs once; pairs are dealt by a
hash of both words, so a frequent word's restaurant is spread. What comes back to a block has no keys, only values in the order
in which it asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from litmill.llm.common import crc_remainder, prefix_sums, release, table, tasks
from litmill.session import cut_lineage, ensure_checkpoint_dir

MIN_COUNT = 10
BURN_IN, SWEEPS = 1, 4
STRENGTH, STEPS = 1.0, 64
BLOCK_TOKENS = 2_000_000
RARE = 0

SEQUENCE = 1 << 20  # blocks of a task
PAIR = np.dtype([("u", "<i4"), ("w", "<i4"), ("n", "<i4")])
LONE = np.dtype([("u", "<i4"), ("w", "<i4")])
OWN = np.dtype([("u", "<i4"), ("w", "<i4"), ("own", "<f4")])


def tokens(text: str | None) -> list[bytes]:
    """Words of the text, A-Z lower-cased, then the end (an empty word). Python's blanks for bytes are the six ASCII ones."""
    out = (text or "").encode().lower().split()
    out.append(b"")
    return out


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when each has ended, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


class Rewritten:
    """A table in the shared folder that is written again and again: two folders in turn, so the version before the last goes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.turn = spark, f"{ensure_checkpoint_dir(spark)}/turns-{uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        self.turn += 1
        path = f"{self.folder}/{self.turn % 2}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def end(self) -> None:
        """What was written goes; nothing reads it any more."""
        for turn in (0, 1):
            self.spark.range(0).write.mode("overwrite").parquet(f"{self.folder}/{turn}")


def planes(values: np.ndarray) -> bytes:
    """First all lowest bytes, then all next ones: small numbers leave runs of zeros, which pack well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def numbers(raw: bytes | pa.Buffer, kind: str) -> np.ndarray:
    """What ``planes`` made into bytes."""
    size = np.dtype(kind).itemsize
    rows = np.frombuffer(raw, np.uint8).reshape(size, len(memoryview(raw)) // size).T
    return np.ascontiguousarray(rows).view(kind).ravel()


def packed(rows: np.ndarray, size: np.ndarray) -> pa.Array:
    """A binary value for each run of ``size`` records, field by field; a run is sorted by its first field, of which the steps are kept."""
    first, *others = rows.dtype.names
    ends = np.cumsum(size)
    runs = [rows[a:b] for a, b in zip(ends - size, ends, strict=True)]
    steps = lambda x: np.diff(x, prepend=x.dtype.type(0))
    return pa.array([b"".join([planes(steps(r[first])), *(planes(r[f].copy()) for f in others)]) for r in runs], pa.binary())


def unpacked(values: pa.ChunkedArray | pa.Array, kind: np.dtype) -> np.ndarray:
    """All records of what ``packed`` made, one value after another."""
    out = [np.zeros(0, kind)]
    for v in values:
        raw = memoryview(v.as_buffer())
        rows, at = np.zeros(len(raw) // kind.itemsize, kind), 0
        for f in kind.names:
            end = at + len(rows) * kind[f].itemsize
            x = numbers(raw[at:end], kind[f].str)
            rows[f] = np.cumsum(x, dtype=x.dtype) if f == kind.names[0] else x
            at = end
        out.append(rows)
    return np.concatenate(out)


# ---- texts to blocks --------------------------------------------------------------------------------------


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def blocks_of(docs: DataFrame) -> DataFrame:
    """One row for each block of ``docs`` (doc_id, text, train): its texts as places in its words, and the words' counts in training.

    A block's words stand by count, the most frequent first, then in byte order.
    """
    kind = docs.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() * SEQUENCE
        place, ids, sizes, train, parts, held = Numbers(), [], [], [], [], 0

        def row() -> pa.RecordBatch:
            words, flat = sorted(place), np.concatenate(parts)
            n = np.bincount(flat, minlength=len(words))
            came = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            order = np.argsort(-n[came], kind="stable")
            rank = np.empty(len(words), np.int32)
            rank[came[order]] = np.arange(len(words), dtype=np.int32)
            places = rank[flat]
            n = np.bincount(places[np.repeat(np.array(train, bool), sizes)], minlength=len(words)).astype(np.int64)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            columns = [pa.array([block], pa.int64()), *map(one, (pa.array(ids, arrow), pa.array(sizes, pa.int32()), pa.array(train, pa.bool_())))]
            columns += [pa.array([planes(places)], pa.binary()), one(pa.array([words[k] for k in order], pa.binary())), one(pa.array(n))]
            return pa.RecordBatch.from_arrays(columns, ["block", "ids", "sizes", "train", "places", "words", "counts"])

        for b in batches:
            for doc, text, use in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                own = tokens(text.as_py())
                parts.append(np.fromiter(map(place.__getitem__, own), np.int32, len(own)))
                ids.append(doc)
                sizes.append(len(own))
                train.append(bool(use))
                held += len(own)
                if held >= BLOCK_TOKENS:
                    yield row()
                    block, place, ids, sizes, train, parts, held = block + 1, Numbers(), [], [], [], [], 0
        if ids:
            yield row()
        release()

    schema = f"block long, ids array<{kind.simpleString()}>, sizes array<int>, train array<boolean>, places binary, words array<binary>, counts array<long>"
    return docs.select("doc_id", "text", "train").mapInArrow(read, schema)


@dataclass
class Vocabulary:
    """known: (block, word_ids, word_counts), the number, RARE below ``min_count``, and count of each block's words in their order;
    counts of training tokens and words."""

    known: DataFrame
    n_tokens: int
    n_words: int
    rare_tokens: int
    rare_words: int
    size: int  # dishes, RARE included


def vocabulary(blocks: DataFrame, min_count: int) -> Vocabulary:
    """Words numbered from 1 by count, then in byte order, so the numbers don't depend on how rows are dealt."""
    each = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "_w"))
    each = each.select("block", "local", F.col("_w.words").alias("word"), F.col("_w.counts").alias("n"))
    # a block has one row for each of its words, so a word has as many rows as blocks at most
    w = Window.partitionBy("word")
    rows = each.withColumns({"c": F.sum("n").over(w), "_one": F.row_number().over(w.orderBy("block")) == 1})
    kept = Rewritten(blocks.sparkSession)
    rows = kept.put(rows.select("block", "local", "c", "_one", F.when(F.col("c") >= min_count, F.col("word")).alias("word")))
    rare = (F.col("c") < min_count) & (F.col("c") > 0)
    sums = [F.sum("c"), F.count_if(F.col("c") > 0), F.sum(F.when(rare, F.col("c"))), F.count_if(rare)]
    n, v, rare_n, rare_v = (int(x or 0) for x in rows.where("_one").agg(*sums).first())
    named = rows.where("_one and word is not null").select("word", (-F.col("c")).alias("_c"), F.lit(1).alias("_n"))
    ids = prefix_sums(named, [], ["_c", "word"], {"_before": "_n"}).select("word", (F.col("_before") + 1).cast("int").alias("id"))
    common = rows.where("word is not null").join(ids, "word").select("block", "local", "c", "id")
    every = rows.where("word is null").select("block", "local", "c", F.lit(RARE).alias("id")).unionByName(common)

    def known(t: pa.Table) -> pa.Table:
        local = t.column("local").to_numpy()
        ids, counts = np.zeros(len(local), np.int32), np.zeros(len(local), np.int64)
        ids[local], counts[local] = t.column("id").to_numpy(), t.column("c").to_numpy()
        return pa.table([t.column("block").slice(0, 1), pa.array([planes(ids)], pa.binary()), pa.array([planes(counts)], pa.binary())], ["block", "word_ids", "word_counts"])

    known = cut_lineage(every.groupBy("block").applyInArrow(known, "block long, word_ids binary, word_counts binary"))
    kept.end()
    return Vocabulary(known, n, v, rare_n, rare_v, v - rare_v + 1)


# ---- pairs ------------------------------------------------------------------------------------------------


def _shard(u: np.ndarray, w: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(u.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _block_pairs(places: np.ndarray, size: np.ndarray, train: np.ndarray, ids: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct pairs by shard, u and w; shard of each; each token's pair). A text's first word has the end before it."""
    word = ids[places].astype(np.int64)
    use = np.repeat(train, size)
    before = np.concatenate([word[-1:], word[:-1]])  # every text ends with the end
    key, at = np.unique(before << 32 | word, return_inverse=True)
    pair = np.zeros(len(key), PAIR)
    pair["u"], pair["w"] = key >> 32, key & 0xFFFFFFFF
    pair["n"] = np.bincount(at[use], minlength=len(key))
    shard = _shard(pair["u"], pair["w"], shards)
    order = np.argsort(shard, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return pair[order], shard[order], place[at]


def _texts(b: pa.RecordBatch | pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, sizes, train, word ids) of a row of blocks."""
    of = lambda c: b.column(c)[k]
    size = of("sizes").values.to_numpy().astype(np.int64)
    return numbers(of("places").as_buffer(), "<i4"), size, of("train").values.to_numpy(zero_copy_only=False), numbers(of("word_ids").as_buffer(), "<i4")


def block_pairs(blocks: DataFrame, known: DataFrame, shards: int) -> DataFrame:
    """(block, shard, pairs): the distinct pairs of each block; n: how often in rows that ``train``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                pair, shard, _ = _block_pairs(*_texts(b, k), shards)
                size = np.bincount(shard, minlength=shards)
                some = np.flatnonzero(size)
                block = pa.array([b.column("block")[k].as_py()] * len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([block, pa.array(some.astype(np.int32)), packed(pair, size[some])], ["block", "shard", "pairs"])
        release()

    rows = blocks.select("block", "sizes", "train", "places").join(known, "block")
    return rows.mapInArrow(count, "block long, shard int, pairs binary")


def counted(asks: DataFrame) -> DataFrame:
    """(shard, lone, busy): the pairs seen once in training, and those seen more often, one row for each shard."""

    def merge(t: pa.Table) -> pa.Table:
        rows = unpacked(t.column("pairs"), PAIR)
        rows = rows[rows["n"] > 0]
        key, at = np.unique(rows["u"].astype(np.int64) << 32 | rows["w"], return_inverse=True)
        pair = np.zeros(len(key), PAIR)
        pair["u"], pair["w"] = key >> 32, key & 0xFFFFFFFF
        pair["n"] = np.minimum(np.bincount(at, weights=rows["n"], minlength=len(key)), 2**31 - 1)
        once = pair["n"] == 1
        lone = np.zeros(int(once.sum()), LONE)
        lone["u"], lone["w"] = pair["u"][once], pair["w"][once]
        values = [packed(x, np.array([len(x)])) for x in (lone, pair[~once])]
        return pa.table([t.column("shard").slice(0, 1), *values], ["shard", "lone", "busy"])

    return asks.groupBy("shard").applyInArrow(merge, "shard int, lone binary, busy binary")


def _busy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = unpacked(b.column(0), PAIR)
        one = np.ones(len(rows), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows["u"].copy(), rows["w"].copy(), rows["n"].astype(np.int64), one, one * 0)], ["u", "w", "n", "t", "sum"])


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, c, t_u, one_u, t_w, one_w): of each word in a shard, its customers and dishes as a context, its contexts as a dish."""
    for b in batches:
        lone, busy = unpacked(b.column(0), LONE), unpacked(b.column(1), PAIR)
        ids = np.unique(np.concatenate([lone["u"], lone["w"], busy["u"], busy["w"]]))
        sums = lambda rows, f, weights=None: np.bincount(np.searchsorted(ids, rows[f]), weights, len(ids)).astype(np.int64)
        once, many = [sums(lone, f) for f in "uw"], [sums(busy, f) for f in "uw"]
        columns = [once[0] + sums(busy, "u", busy["n"]), once[0] + many[0], once[0], once[1] + many[1], once[1]]
        yield pa.RecordBatch.from_arrays([pa.array(ids), *map(pa.array, columns)], ["id", "c", "t_u", "one_u", "t_w", "one_w"])


# ---- sweeps -----------------------------------------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers (the finaliser of SplitMix64; its factors are fixed)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seated(customers: np.ndarray, fresh: Callable[[np.ndarray, np.ndarray], np.ndarray], discount: float, key: np.ndarray, sweep: int, steps: int = STEPS) -> np.ndarray:
    """Tables that the ``customers`` of each dish take, seated one after another; the first opens one.

    fresh(which, tables): weight of a new table of these dishes that have so many tables by then. The first ``steps`` customers
    are seated singly; later ones come in groups, each as large as all before it, that take their expected number of tables,
    rounded at random: within a group the chance of a new table changes by less than two. Draws are hashes of ``key``.
    """
    t = np.minimum(customers, 1)
    place, last, step = 1, int(customers.max()) if len(customers) else 0, 0
    base = mixed(key.astype(np.uint64) + np.uint64(sweep) * np.uint64(0xD1342543DE82EF95))
    while place < last:
        more = np.flatnonzero(customers > place)
        group = 1 if place < steps else place
        n, new = np.minimum(customers[more] - place, group), fresh(more, t[more])
        p = new / (new + np.maximum(place + (n - 1) / 2 - discount * t[more], 1e-9))
        draw = (mixed(base[more] + np.uint64(step)) >> np.uint64(11)) * 2.0**-53
        t[more] += np.floor(n * p + draw).astype(t.dtype)
        place, step = place + group, step + 1
    return t


@dataclass
class Model:
    """words: (id, c, back, shared), arrays over the kept sweeps: what a context passes on, and the parent's probability of the dish;
    busy: (u, w, n, t, sum) of the pairs seen more than once, sum: tables over the kept sweeps; pairs: as ``counted``."""

    words: DataFrame
    busy: DataFrame
    pairs: DataFrame
    own: float  # discount in the contexts
    kept: int


def train(pairs: DataFrame, dishes: int, sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> Model:
    """The model from ``pairs`` (``counted``). The discounts are n1 / (n1 + 2 n2) of the dishes served once and twice."""
    spark = pairs.sparkSession
    zero, none, names = F.lit(0).cast("long"), F.array().cast("array<double>"), ("c", "t_u", "one_u", "t_w", "one_w")
    sides = pairs.select("lone", "busy").mapInArrow(_sides, "id int, c long, t_u long, one_u long, t_w long, one_w long")
    sides = sides.unionByName(spark.range(1).select(F.lit(RARE).alias("id"), *[zero.alias(c) for c in names]))
    words = sides.groupBy("id").agg(*[F.sum(c).alias(c) for c in names])
    kept_words, kept_busy = Rewritten(spark), Rewritten(spark)
    words = kept_words.put(words.withColumns({"up": F.least("t_w", F.lit(1)), "back": none, "shared": none}))
    busy = kept_busy.put(pairs.select("busy").mapInArrow(_busy, "u int, w int, n long, t long, sum long"))
    sums = [F.sum("t_w"), F.sum("up"), F.sum("one_w"), F.count_if(F.col("t_w") == 1), F.count_if(F.col("t_w") == 2)]
    total, parents, n1, p1, p2 = (int(x or 0) for x in words.agg(*sums).first())
    n2 = busy.where("n = 2").count()
    own, above = (min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5 for a, b in ((n1, n2), (p1, p2)))
    base, kept = 1 / dishes, 0
    for sweep in range(sweeps):
        keep = int(sweep >= burn_in)

        def seat(batches: Iterator[pa.RecordBatch], sweep=sweep, keep=keep, total=total, parents=parents) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    u, w, n, old, sums, t_u, t_w, up = (x.to_numpy() for x in b.columns)
                    u_rest, w_rest, floor = t_u - old, t_w - old, (STRENGTH + above * parents) * base

                    def fresh(k: np.ndarray, t: np.ndarray, of=(old, u_rest, w_rest, up), floor=floor) -> np.ndarray:
                        old, u_rest, w_rest, up = (x[k] for x in of)
                        at = w_rest + t
                        parent = (at - above * np.minimum(up, at) + floor) / (STRENGTH + total - old + t)
                        return (STRENGTH + own * (u_rest + t)) * parent

                    t = seated(n, fresh, own, u.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64), sweep)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (u, w, n, t, sums + keep * t)], ["u", "w", "n", "t", "sum"])

        of_u, of_w = words.select(F.col("id").alias("u"), "t_u"), words.select(F.col("id").alias("w"), "t_w", "up")
        at = busy.join(of_u, "u").join(of_w, "w").select("u", "w", "n", "t", "sum", "t_u", "t_w", "up")
        busy = kept_busy.put(at.mapInArrow(seat, "u int, w int, n long, t long, sum long"))
        tabled = [busy.groupBy(F.col(c).alias("id")).agg(F.sum("t").alias(f"_{c}")) for c in "uw"]
        new = reduce(lambda a, b: a.join(b, "id", "left"), tabled, words)
        new = new.withColumns({f"t_{c}": F.col(f"one_{c}") + F.coalesce(f"_{c}", zero) for c in "uw"}).drop("_u", "_w")

        def seat_parent(batches: Iterator[pa.RecordBatch], sweep=sweep, parents=parents) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    rest = parents - b.column("up").to_numpy()
                    fresh = lambda k, t, rest=rest: (STRENGTH + above * (rest[k] + t)) * base
                    up = seated(b.column("t_w").to_numpy(), fresh, above, b.column("id").to_numpy(), sweep)
                    yield b.set_column(b.schema.get_field_index("up"), "up", pa.array(up))

        new = kept_words.put(new.mapInArrow(seat_parent, new.schema))
        total, parents = (int(x or 0) for x in new.agg(F.sum("t_w"), F.sum("up")).first())
        words = new
        if keep or sweep + 1 == sweeps and not kept:
            kept += 1
            back = (STRENGTH + own * F.col("t_u")) / (STRENGTH + F.col("c"))
            shared = (F.col("t_w") - above * F.col("up") + (STRENGTH + above * parents) * base) / (STRENGTH + total)
            words = words.withColumns({"back": F.concat("back", F.array(back)), "shared": F.concat("shared", F.array(shared))})
            busy = busy if keep else busy.withColumn("sum", F.col("t"))
    return Model(cut_lineage(words.select("id", "c", "back", "shared")), busy, pairs, own, kept)


# ---- scores -----------------------------------------------------------------------------------------------


def answered(asks: DataFrame, model: Model, shards: int) -> DataFrame:
    """(block, shard, own): what each asked pair keeps after the discount, averaged over the kept sweeps; 32-bit floats in the order asked."""
    own, kept = model.own, model.kept

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = np.zeros(b.num_rows, OWN)
                rows["u"], rows["w"], rows["own"] = (x.to_numpy() for x in b.columns)
                rows = rows[np.argsort(rows["u"], kind="stable")]
                shard = _shard(rows["u"], rows["w"], shards)
                size = np.bincount(shard, minlength=shards)
                some = np.flatnonzero(size)
                values = packed(rows[np.argsort(shard, kind="stable")], size[some])
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), values, pa.nulls(len(some), pa.binary())], ["shard", "busy", "lone"])

    def answer(asks: pa.Table, known: pa.Table) -> pa.Table:
        once, more = unpacked(known.column("lone").drop_null(), LONE), unpacked(known.column("busy").drop_null(), OWN)
        key = np.concatenate([x["u"].astype(np.int64) << 32 | x["w"] for x in (once, more)])
        order = np.argsort(key)
        key, value = np.append(key[order], -1), np.append(np.concatenate([np.full(len(once), 1 - own, "<f4"), more["own"]])[order], np.float32(0))
        out = []
        for blob in asks.column("pairs"):
            mine = unpacked([blob], PAIR)
            asked = mine["u"].astype(np.int64) << 32 | mine["w"]
            at = np.searchsorted(key[:-1], asked)
            out.append(planes(np.where(key[at] == asked, value[at], np.float32(0)).astype("<f4")))
        return pa.table([asks.column("block"), asks.column("shard"), pa.array(out, pa.binary())], ["block", "shard", "own"])

    seats = model.busy.select("u", "w", (F.col("n") - own * F.col("sum") / kept).alias("own")).mapInArrow(deal, "shard int, busy binary, lone binary")
    known = seats.unionByName(model.pairs.select("shard", F.lit(None).cast("binary").alias("busy"), "lone"))
    return asks.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(answer, "block long, shard int, own binary")


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, id) of the numbered words of each block."""
    for b in batches:
        for block, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids = numbers(ids.as_buffer(), "<i4")
            ids = ids[ids != RARE]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block, np.int64)), pa.array(ids)], ["block", "id"])


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, word_ids, chances): the rows of each block in a batch together; chances: 32-bit, those passed on, then those of the parent."""
    for b in batches:
        if b.num_rows:
            of, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            both = np.concatenate([b.column(c).flatten().to_numpy().reshape(len(of), -1) for c in (2, 3)], axis=1).astype("<f4")
            runs = [(x, np.flatnonzero(of == x)) for x in np.unique(of)]
            values = [[ids[at].astype("<i4").tobytes() for _, at in runs], [both[at].tobytes() for _, at in runs]]
            yield pa.RecordBatch.from_arrays([pa.array([int(x) for x, _ in runs], pa.int64()), *[pa.array(v, pa.binary()) for v in values]], ["block", "word_ids", "chances"])


def score(blocks: DataFrame, asks: DataFrame, words: Vocabulary, model: Model, shards: int) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each text of ``blocks``."""
    n, v, rare_n, rare_v, dishes, kept = words.n_tokens, words.n_words, words.rare_tokens, words.rare_words, words.size, max(1, model.kept)
    none = {c: F.lit(None).cast(t) for c, t in (("shard", "int"), ("own", "binary"), ("word_ids", "binary"), ("chances", "binary"))}
    at = words.known.select("block", "word_ids").mapInArrow(_common, "block long, id int").join(model.words.select("id", "back", "shared"), "id")
    at = at.select("block", "id", "back", "shared").mapInArrow(_by_block, "block long, word_ids binary, chances binary")
    at = at.withColumns({c: none[c] for c in ("shard", "own")})
    own = answered(asks, model, shards).withColumns({c: none[c] for c in ("word_ids", "chances")})
    # the one class of all rare words is a few numbers
    rare = model.words.where(F.col("id") == RARE).first()
    rare_back, rare_shared, rare_c = rare["back"], rare["shared"], rare["c"]
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def judge(blocks: pa.Table, known: pa.Table) -> pa.Table:
        own = known.filter(known.column("own").is_valid()).sort_by("shard")
        rows = known.filter(known.column("word_ids").is_valid())
        asked = np.concatenate([np.zeros(0, "<i4"), *[np.frombuffer(x.as_buffer(), "<i4") for x in rows.column("word_ids")]])
        chances = np.concatenate([np.zeros((0, 2 * kept), "<f4"), *[np.frombuffer(x.as_buffer(), "<f4").reshape(-1, 2 * kept) for x in rows.column("chances")]])
        word, size, train, id_of = _texts(blocks, 0)
        c = numbers(blocks.column("word_counts")[0].as_buffer(), "<i8")
        common = np.flatnonzero(id_of != RARE)
        values = np.empty((len(c), 2 * kept))
        values[:] = [*rare_back, *rare_shared]
        order = np.argsort(asked)
        values[common] = chances[order[np.searchsorted(asked[order], id_of[common])]]
        back, shared = values[:, :kept], values[:, kept:]
        customers = np.where(id_of == RARE, rare_c, c)
        # a rare word's share of its class, in which all unknown words are one
        share = np.where(id_of == RARE, (c + 0.5) / (rare_n + 0.5 * (rare_v + 1)), 1.0)
        before = np.concatenate([word[-1:], word[:-1]])
        pair = _block_pairs(word, size, train, id_of, shards)[2]
        p = np.concatenate([numbers(x.as_buffer(), "<f4") for x in own.column("own")])[pair] / (STRENGTH + customers[before]) * kept
        for k in range(kept):
            p += back[before, k] * shared[word, k]
        logs = np.log10(p / kept * share[word])
        del pair, p, before
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))[word]
        first = np.cumsum(size) - size
        sums = [np.add.reduceat(x, first) for x in (np.ones(len(word), np.int64), (c > 0)[word].astype(np.int64), base, logs)]
        return pa.table([blocks.column("ids")[0].values, *map(pa.array, sums)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    left = blocks.select("block", "ids", "sizes", "train", "places").join(words.known, "block")
    left = left.select(*[F.col(c).alias(c) for c in left.columns])
    return left.groupBy("block").cogroup(own.unionByName(at).groupBy("block")).applyInArrow(judge, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def learnt(docs: DataFrame, min_count: int = MIN_COUNT, sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> tuple[DataFrame, DataFrame, Vocabulary, Model, int]:
    """(blocks, asks, vocabulary, model, shards) of ``docs`` (doc_id, text, train)."""
    spark = docs.sparkSession
    with shuffles_end(spark):
        read = Rewritten(spark)
        every = read.put(blocks_of(docs))
        blocks = cut_lineage(every.drop("words", "counts"))
        words = vocabulary(every.select("block", "words", "counts"), min_count)
        read.end()
        shards = max(tasks(spark), blocks.count())
        asks = cut_lineage(block_pairs(blocks, words.known, shards))
        model = train(cut_lineage(counted(asks)), words.size, sweeps, burn_in)
    return blocks, asks, words, model, shards


def pitman_yor_scores(docs: DataFrame, held: Column, min_count: int = MIN_COUNT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of ``docs`` (doc_id, text; others are ignored).

    The model learns from all whole texts but those for which ``held`` (a column of doc_id) is true. Tokens are the words, A-Z
    lower-cased, and one end for each text; null and empty texts have the end alone. base_score: additive smoothing (0.5) of the
    training tokens; score: log10 of the model's probability, in which all unknown words are one word. Words seen fewer than
    ``min_count`` times in training share a dish and a context. Rows that repeat count and are scored each. With nothing to
    learn from, both scores are 0. An empty table gives no rows. Rows dealt otherwise give equal scores.
    """
    blocks, asks, words, model, shards = learnt(docs.select("doc_id", "text", (~held).alias("train")), min_count)
    out = score(blocks, asks, words, model, shards)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    tokens_ = F.lit(words.n_tokens).cast("long").alias("train_tokens")
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", tokens_, "base_score", "score", perplexity.alias("perplexity"))


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor_scores(table(spark, sf_dir, "documents", "doc_id", "text"), crc_remainder("doc_id", 5) == 1)
