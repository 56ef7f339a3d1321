"""Jaccard join of word n-gram sets that uses relations between sets to skip work.

Index level: the tokens of a set are ordered from rare to frequent, and a set is listed under its first tokens only. Lists
are sorted by size and carry positions, so whole blocks of a list whose size or position can't reach the overlap are
skipped. Answer level: a set is compared with the leader of its list first. Sets linked to one leader are in one
component already, and the overlap with the leader bounds a set's overlap with the leader's other partners, so most of
the remaining pairs are decided without reading the sets. A first round does so for sets that share one of their LOWEST
smallest hashes, which finds most large groups; lists whose sets are all in one component by then are skipped whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmill.llm.common import release, table
from litmill.session import cut_lineage

N, PERCENT = 5, 75
CHUNK = 1 << 21
SKETCH_BITS, SLICES = 22, 64
PARITY_BITS = 1024
BLOOM_BITS = 1 << 23
SHARD_ENTRIES = 400_000
SHORT_LIST = 64
LOWEST, LEADERS, ROUNDS = 4, 24, 1

ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3; its two factors are fixed values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, powers of its inverse, and a 64-bit value for each byte (A-Z as a-z)."""
    inverse = np.uint64(pow(int(ODD), -1, 2**64))
    up, down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, k, np.uint64)])) for k in (ODD, inverse))
    of = mixed(np.arange(1, 257, dtype=np.uint64) * ODD)
    of[65:91] = of[97:123]
    return up, down, of


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end) of UTF-8 texts that lie one after another in ``data``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    up, down, of = _powers(max(CHUNK, 1 << (n - 1).bit_length()))
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    starts = np.flatnonzero(word & (~before | edge[:n]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    sums = np.concatenate([[np.uint64(0)], np.cumsum(of[data] * up[:n], dtype=np.uint64)])
    return mixed((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct hashes of each text's word n-grams, sorted; a text of fewer words has its whole sequence as one."""
    texts = texts.fill_null("") if texts.null_count else texts
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
        hashes, first = word_hashes(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
        grams = np.zeros(0, np.uint64)
        if len(hashes) >= N:
            grams = np.zeros(len(hashes) - N + 1, np.uint64)
            for k in range(N):
                grams = (grams + hashes[k : len(hashes) - N + 1 + k]) * ODD
            grams = mixed(grams)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= N:
                yield np.unique(grams[a : b - N + 1])
            elif b > a:
                whole = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for h in hashes[a:b]:
                        whole = (whole + h) * ODD
                yield mixed(np.array([whole]) ^ ODD)
            else:
                yield np.zeros(0, np.uint64)
        at = to


def digest(s: np.ndarray) -> int:
    """The id of a set: equal for equal sets, and different for others but for chances of 2^-64 a pair."""
    return int((mixed(s * ODD + np.uint64(1)).sum(dtype=np.uint64) + np.uint64(len(s))).astype(np.int64))


def parity(s: np.ndarray) -> np.ndarray:
    """Which of PARITY_BITS remainders occur oddly often: the bits in which two sets differ can't outnumber their difference."""
    odd = np.bincount((s % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def can_link(n_a: Column, p_a: Column, n_b: Column, p_b: Column) -> Column:
    """Whether sizes and parities let two sets link: their overlap is at most (total - differing bits) / 2."""
    differ = sum((F.bit_count(p_a[k].bitwiseXOR(p_b[k])) for k in range(1, PARITY_BITS // 64)), F.bit_count(p_a[0].bitwiseXOR(p_b[0])))
    total = n_a + n_b
    return (100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)) & ((100 + PERCENT) * (total - differ) >= 2 * PERCENT * total)


def described(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """((doc_id, mark, n, digest, parity, low), counts of all tokens in 2^SKETCH_BITS buckets, saturating) of ``docs`` (doc_id, text).

    mark: a hash of the text. low: the LOWEST smallest tokens. The counts have a fixed size; they only order the tokens, and
    any order gives the same links.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "mark", "n", "digest", "parity", "low", "slice", "counts"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        key = None
        for b in batches:
            key = b.schema.field(0).type
            n, ids, odd, low, tokens = [], [], [], [], []
            for s in shingle_sets(b.column(2)):
                n.append(len(s))
                ids.append(digest(s) if len(s) else None)
                odd.append(parity(s) if len(s) else None)
                low.append(s[:LOWEST].view(np.int64))
                tokens.append((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64))
                if len(tokens) == 512:
                    counts += np.bincount(np.concatenate(tokens), minlength=len(counts)).astype(np.uint32)
                    tokens = []
            if tokens:
                counts += np.bincount(np.concatenate(tokens), minlength=len(counts)).astype(np.uint32)
            cols = [pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(odd, pa.list_(pa.int64())), pa.array(low, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols, pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        release()
        if key is not None:
            parts = [p.tobytes() for p in np.split(np.minimum(counts, 65535).astype("<u2"), SLICES)]
            none = [pa.nulls(SLICES, t) for t in (key, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names)

    rows = cut_lineage(
        docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(
            scan, f"doc_id {kind}, mark long, n long, digest long, parity array<long>, low array<long>, slice int, counts binary"
        )
    )

    def added(t: pa.Table) -> pa.Table:
        total = np.zeros((1 << SKETCH_BITS) // SLICES, np.uint32)
        for c in t.column("counts"):
            total += np.frombuffer(c.as_buffer(), "<u2")
        return pa.table({"slice": t.column("slice")[:1], "counts": pa.array([np.minimum(total, 65535).astype("<u2").tobytes()], pa.binary())})

    slices = rows.where("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(added, "slice int, counts binary").collect()
    counts = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), "<u2")
    for r in slices:
        counts[r["slice"]] = np.frombuffer(r["counts"], "<u2")
    return rows.where("slice is null").drop("slice", "counts"), counts.reshape(-1)


def prefix_length(n: int) -> int:
    """A set has a partner only if they share one of so many first tokens."""
    return n - -(-PERCENT * n // 100) + 1


def can_reach(size_a: np.ndarray, rest_a: np.ndarray, size_b: np.ndarray, rest_b: np.ndarray) -> np.ndarray:
    """Whether sets that have ``rest`` tokens from a shared one on can overlap enough."""
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    return (100 * small >= PERCENT * large) & ((100 + PERCENT) * np.minimum(rest_a, rest_b) >= PERCENT * (size_a + size_b))


def listed(texts: DataFrame, counts: np.ndarray, shards: int) -> DataFrame:
    """(shard, tokens, ids, moved, sizes, rests): the index entries of ``texts`` (digest, root, text), packed by shard.

    moved: the bits in which an entry's component differs from its set's id.
    """
    order = texts.sparkSession.sparkContext.broadcast(counts)  # 2^SKETCH_BITS numbers of two bytes at any scale

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = order.value
        for b in batches:
            parts = []
            for own, root, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), shingle_sets(b.column(2)), strict=True):
                k = prefix_length(len(s))
                key = rank[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                first = s[np.lexsort((s, key))[:k]]
                parts.append((first, np.full(k, own, np.int64), np.full(k, own ^ root, np.int64), np.full(k, len(s), np.int32), (len(s) - np.arange(k)).astype(np.int32)))
            if not parts:
                continue
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
            shard = (mixed(cols[0] ^ ODD) % np.uint64(shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[by], np.arange(shards + 1))
            full = np.flatnonzero(np.diff(edges))
            cols = [c[by] for c in cols]
            packed = [pa.array([c[edges[k] : edges[k + 1]].tobytes() for k in full], pa.binary()) for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), *packed], ["shard", "tokens", "ids", "moved", "sizes", "rests"])
        release()

    return texts.select("digest", "root", "text").mapInArrow(scan, "shard long, tokens binary, ids binary, moved binary, sizes binary, rests binary")


def paired(entries: DataFrame) -> DataFrame:
    """(a, b, leader, long): pairs of sets of different components that share a list and may reach the overlap; a < b.

    Lists of one component give none. In a list of at most SHORT_LIST sets all such pairs are given, those with the list's
    leader (its smallest id) as ``leader`` true. In a longer list each set is paired with the leader alone, ``long`` true;
    ``more_pairs`` gives the rest.
    """

    def pairs(t: pa.Table) -> pa.Table:
        token, own, root, size, rest = (
            np.concatenate([np.frombuffer(x.as_buffer(), k) for x in t.column(c)])
            for c, k in (("tokens", "<u8"), ("ids", "<i8"), ("moved", "<i8"), ("sizes", "<i4"), ("rests", "<i4"))
        )
        root = own ^ root
        by = np.lexsort((own, token))
        token, own, root, size, rest = (x[by] for x in (token, own, root, size.astype(np.int64), rest.astype(np.int64)))
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        mixed_ = np.repeat(np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first), np.diff(np.append(first, len(token))))
        token, own, root, size, rest = (x[mixed_] for x in (token, own, root, size, rest))
        if not len(token):
            return pa.table({c: pa.array([], k) for c, k in (("a", pa.int64()), ("b", pa.int64()), ("leader", pa.bool_()), ("long", pa.bool_()))})
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(np.append(first, len(token)))
        lead = np.repeat(first, length)
        n = np.repeat(length, length)
        out = []
        far = np.flatnonzero((n > SHORT_LIST) & (own != own[lead]))
        if len(far):
            # the block of a list that holds no set small enough for the position of this one is skipped
            least = np.repeat(np.minimum.reduceat(size, first), length)[far]
            least = np.maximum(least, -(-PERCENT * size[far] // 100))
            far = far[(100 + PERCENT) * rest[far] >= PERCENT * (size[far] + least)]
            out.append(np.stack([own[lead[far]], own[far], np.ones(len(far), np.int64), np.ones(len(far), np.int64)], 1))
        short = np.flatnonzero((n > 1) & (n <= SHORT_LIST))
        step = 1
        while len(short):
            short = short[(short + step < len(token))]
            short = short[token[np.minimum(short + step, len(token) - 1)] == token[short]]
            i, j = short, short + step
            ok = can_reach(size[i], rest[i], size[j], rest[j]) & (root[i] != root[j])
            i, j = i[ok], j[ok]
            out.append(np.stack([own[i], own[j], (i == lead[i]).astype(np.int64), np.zeros(len(i), np.int64)], 1))
            step += 1
        rows = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 4), np.int64)
        return pa.table({"a": rows[:, 0], "b": rows[:, 1], "leader": rows[:, 2].astype(bool), "long": rows[:, 3].astype(bool)})

    found = entries.groupBy("shard").applyInArrow(pairs, "a long, b long, leader boolean, long boolean")
    return found.groupBy("a", "b").agg(F.max("leader").alias("leader"), F.max("long").alias("long"))


def may_link(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with n_a, n_b of ``sets`` (digest, n, parity), without those that sizes or parities rule out."""
    a, b = (sets.select(F.col("digest").alias(k), F.col("n").alias(f"n_{k}"), F.col("parity").alias(f"_p{k}")) for k in "ab")
    both = pairs.join(a, "a").join(b.withColumnRenamed("b", "_b"), (F.col("b") == F.col("_b")) & can_link(F.col("n_a"), F.col("_pa"), F.col("n_b"), F.col("_pb")))
    return both.drop("_pa", "_pb", "_b")


def packed_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, tokens): the sets in ``wanted`` (digest), once each, six bytes a token.

    A bit map of fixed size keeps nearly all other sets out of the shuffle; the join keeps out the rest.
    """
    at = F.pmod(F.col("digest"), F.lit(BLOOM_BITS))
    maps = wanted.groupBy(F.expr(f"bitmap_bucket_number(pmod(digest, {BLOOM_BITS}) + 1)").alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at + 1)).alias("bits")
    )
    bits = np.zeros((BLOOM_BITS // 32768 + 2, 4096), np.uint8)
    for r in maps.collect():
        bits[r["k"]] = np.frombuffer(r["bits"], np.uint8)
    known = docs.sparkSession.sparkContext.broadcast(np.unpackbits(bits[1:], bitorder="little").astype(bool))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = known.value
        for b in batches:
            out: dict[int, bytes] = {}
            for s in shingle_sets(b.column(0)):
                if len(s) and some[(own := digest(s)) % BLOOM_BITS] and own not in out:
                    out[own] = s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], ["digest", "tokens"])
        release()

    found = docs.select("text").mapInArrow(scan, "digest long, tokens binary")
    return found.join(wanted, "digest").groupBy("digest").agg(F.first("tokens").alias("tokens"))


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with ``common``, the size of the two sets' intersection; ``sets`` has (digest, tokens)."""
    out = pairs
    for k in "ab":
        out = out.join(sets.select(F.col("digest").alias(k), F.col("tokens").alias(f"_t{k}")), k)

    def tokens(x: pa.Scalar) -> np.ndarray:
        wide = np.zeros((len(x.as_buffer()) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 6)
        return wide.view("<u8").reshape(-1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            n = [len(np.intersect1d(tokens(x), tokens(y))) for x, y in zip(t.column("_ta"), t.column("_tb"), strict=True)]
            yield from t.drop_columns(["_ta", "_tb"]).append_column("common", pa.array(n, pa.int64())).to_batches()

    kept = [f for f in pairs.schema.fields]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + ["common long"])
    return out.select(*[f.name for f in kept], "_ta", "_tb").mapInArrow(count, schema)


LINKED = f"100 * common >= {PERCENT} * (n_a + n_b - common)"


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): root is the smallest node that it reaches.

    Rounds of two steps: all larger neighbours of a node, then all smaller ones, move to the node's smallest neighbour. The
    smallest neighbour is an aggregate, so no list of neighbours is built.
    """
    edges = cut_lineage(links.select("a", "b").distinct())
    before = None
    while True:
        for larger in (True, False):
            both = edges.union(edges.select("b", "a")) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
            moved = both.join(low, "a")
            if larger:
                moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
            else:
                moved = moved.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
            edges = cut_lineage(moved.where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(edges.select("b", "b").distinct())
        before = now


def more_pairs(checked: DataFrame, sets: DataFrame, roots: DataFrame, leaders: int | None = None, seed: int = 0) -> DataFrame:
    """(a, b): pairs of long lists that the first comparison leaves open, as far as their sets aren't in one component by now.

    They are the pairs of a set that isn't linked to the leader with the leader's other partners; with ``leaders``, of so many
    such sets of each leader only. With overlaps x and y with the leader, two sets share at most min(x, y) of its tokens and
    min(rest, rest) others; pairs that can't link by that are left out.
    """
    star = checked.where("long").select(F.col("a").alias("l"), F.col("b").alias("node"), F.col("n_b").alias("n"), "common", F.expr(LINKED).alias("ok"))
    star = star.join(roots, "node", "left").join(sets.select(F.col("digest").alias("node"), "parity"), "node")
    star = cut_lineage(star.select("l", F.col("node").alias("m"), "n", "common", "ok", F.coalesce("root", "node").alias("root"), "parity"))
    x, y = (star.select("l", *[F.col(c).alias(f"{c}{k}") for c in ("m", "n", "common", "ok", "root", "parity")]) for k in (1, 2))
    x = x.where("not ok1")
    if leaders:
        x = x.withColumn("_k", F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("m1", F.lit(seed)), "m1"))).where(F.col("_k") <= leaders).drop("_k")
    most = F.least("common1", "common2") + F.least(F.col("n1") - F.col("common1"), F.col("n2") - F.col("common2"))
    cross = x.join(y, "l").where("root1 <> root2" if leaders else "root1 <> root2 and (ok2 or m1 < m2)")
    cross = cross.where(((100 + PERCENT) * most >= PERCENT * (F.col("n1") + F.col("n2"))) & can_link(F.col("n1"), F.col("parity1"), F.col("n2"), F.col("parity2")))
    return cross.select(F.least("m1", "m2").alias("a"), F.greatest("m1", "m2").alias("b")).distinct()


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose ends are in different components by ``roots`` (node, root)."""
    open_ = pairs
    for k in "ab":
        r = roots.select(F.col("node").alias(k), F.col("root").alias(f"_r{k}"))
        open_ = open_.join(r, k, "left").withColumn(f"_r{k}", F.coalesce(f"_r{k}", k))
    return open_.where("_ra <> _rb").select("a", "b")


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after more ``links`` (a, b): only components are linked, not their nodes once more."""
    ends = links
    for k in "ab":
        r = roots.select(F.col("node").alias(k), F.col("root").alias(f"_r{k}"))
        ends = ends.join(r, k, "left").withColumn(f"_r{k}", F.coalesce(f"_r{k}", k))
    ends = cut_lineage(ends.select("a", "b", "_ra", "_rb"))
    above = components(ends.where("_ra <> _rb").select(F.least("_ra", "_rb").alias("a"), F.greatest("_ra", "_rb").alias("b")))
    nodes = roots.union(ends.select("a", "_ra")).union(ends.select("b", "_rb")).distinct()
    up = above.select(F.col("node").alias("root"), F.col("root").alias("_up"))
    return cut_lineage(nodes.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root")))


def low_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): each set of ``sets`` (digest, low) with the leader of those that share one of its smallest tokens; a < b."""
    rows = cut_lineage(sets.select("digest", F.explode("low").alias("token")))
    leader = rows.groupBy("token").agg(F.min("digest").alias("a"), F.max("digest").alias("_last")).where("a < _last").drop("_last")
    return rows.join(leader, "token").where("digest <> a").select("a", F.col("digest").alias("b")).distinct()


def similarity_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text; others are ignored).

    Sets are the distinct 5-word shingles of the text, A-Z lower-cased, words divided by ASCII white space; fewer words are
    one shingle. Two rows are linked where 100 * intersection >= 75 * union; component_id is the smallest doc_id that links
    reach. Null, empty and blank texts have no set and are linked with nothing, not even each other: they keep their own id.
    Rows that repeat are linked like any others. A null doc_id takes part, is never the smallest, and stays null where a
    component has no other. An empty table gives no rows. Tokens are compared by 64-bit hashes, 48 bits between two sets.
    """
    spark = docs.sparkSession
    rows, counts = described(docs)
    first_ = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    sets = rows.where("n > 0").groupBy("digest").agg(F.min(first_).alias("f"), *[F.first(c).alias(c) for c in ("n", "parity", "low")])
    sets = cut_lineage(sets.select("digest", F.col("f.doc_id").alias("id"), F.col("f.mark").alias("mark"), "n", "parity", "low"))

    def wanted(*pairs: DataFrame) -> DataFrame:
        ends = [p.select(F.col(k).alias("digest")) for p in pairs for k in "ab"]
        out = ends[0]
        for e in ends[1:]:
            out = out.union(e)
        return out.distinct()

    near = cut_lineage(may_link(low_pairs(sets), sets))
    links = cut_lineage(overlaps(near, cut_lineage(packed_sets(docs, wanted(near)))).where(LINKED).select("a", "b"))
    roots = cut_lineage(components(links))

    # one text of each set, with its component; the text is found by its id and its hash, which no hot key has
    known = sets.join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    known = known.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), "digest", F.coalesce("root", "digest").alias("root"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").join(known, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    size = sets.agg(F.sum("n")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size * (100 - PERCENT) // 100 // SHARD_ENTRIES))
    pairs = cut_lineage(paired(listed(texts, counts, shards)))
    first = cut_lineage(may_link(pairs.where("leader or long"), sets))
    later = cut_lineage(may_link(pairs.where("not leader and not long"), sets))
    # the overlap with a long list's leader bounds others, so it is counted even where the two can't be linked
    size_of = sets.select(F.col("digest"), "n")
    ruled = pairs.where("long").join(first.select("a", "b"), ["a", "b"], "left_anti")
    for k in "ab":
        ruled = ruled.join(size_of.select(F.col("digest").alias(k), F.col("n").alias(f"n_{k}")), k)
    first = cut_lineage(first.unionByName(ruled))
    tokens = cut_lineage(packed_sets(docs, wanted(first, later)))
    checked = cut_lineage(overlaps(first, tokens))
    roots = joined(roots, checked.where(LINKED).select("a", "b"))
    # then the short lists' other pairs and some more leaders of each long list, in the end whatever is left
    for k in range(ROUNDS + 1):
        rest = more_pairs(checked, sets, roots, LEADERS if k < ROUNDS else None, k)
        rest = rest if k else rest.union(apart(later.select("a", "b"), roots)).distinct()
        rest = cut_lineage(may_link(rest, sets))
        if not rest.isEmpty():
            # pairs of a long list may be of sets that were in no pair before
            lacking = wanted(rest).join(tokens.select("digest"), "digest", "left_anti")
            if not lacking.isEmpty():
                tokens = tokens.union(cut_lineage(packed_sets(docs, cut_lineage(lacking))))
            roots = joined(roots, overlaps(rest, tokens).where(LINKED).select("a", "b"))
    of = sets.select("digest", "id").join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    of = cut_lineage(of.withColumn("root", F.coalesce("root", "digest")))
    low = of.groupBy("root").agg(F.min("id").alias("component_id"))
    named = of.join(low, "root").select("digest", "component_id")
    out = rows.join(named, "digest", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents", "doc_id", "text"))
