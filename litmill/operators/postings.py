"""Stored postings in blocks, and exact search that skips blocks by what they can score at most.

Chunks are cut into zones of neighbours as they are read. A block is the postings of one term in one zone: places of its chunks
in the zone, counts, lengths, and the largest impact of any of them. Blocks are stored by bucket of their term, batch after batch;
a batch counts from the moment its row is in the table of batches, so one that broke off is never read.

A question's bound in a zone is the sum of its terms' largest impacts there. The zones with the best bounds are scored first;
every other zone whose bound is below the k-th score found so far is skipped: none of its blocks is scored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from litmill.functions import fixed_values as fv
from litmill.functions.skew import top_k
from litmill.functions.text import tokens_of
from litmill.session import cut_lineage

ZONE_CHUNKS, ZONE_TOKENS = 4096, 4_000_000
BUCKETS = 16
PROBED = 2  # zones of a question that are scored before any is skipped
QUESTIONS = 1024  # scored at once, in one zone
SHARE, GROUP, TASKS = 8, 16, 64  # a scoring task: SHARE * QUESTIONS questions and GROUP zones, about; fewer zones while there are less than TASKS tasks
STORED = "term string, zone long, n int, best double, zone_avg double, zone_tokens long, places array<int>, tfs array<int>, dls array<int>"
BATCHES = "batch string, chunk_type string, n_chunks long, n_tokens long"
SLACK = 1e-9  # sums are compared at nine digits


def impact(tf: Column | np.ndarray, dl: Column | np.ndarray, avg_len: Column | float) -> Column | np.ndarray:
    """What one posting adds to a score, before the weight of its term. dl, avg_len: at least 1."""
    return tf * (fv.BM25_K1 + 1) / (tf + fv.BM25_K1 * (1 - fv.BM25_B + fv.BM25_B * dl / avg_len))


def _zone_blocks(name: int, ids: list, tokens: list[pa.Array], kind: pa.DataType) -> pa.RecordBatch:
    """The blocks of a zone, and one row without a term that holds its chunks, sorted by id."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i].encode() if isinstance(ids[i], str) else ids[i]))
    dl = np.array([len(tokens[i]) for i in order], np.int64)
    flat = pa.concat_arrays([tokens[i] for i in order]).dictionary_encode()
    terms = flat.dictionary
    code = flat.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), dl)
    code, tf = np.unique(code, return_counts=True)
    term, place = code // len(ids), code % len(ids)
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    avg = max(1.0, dl.mean())
    best = np.maximum.reduceat(impact(tf, np.maximum(dl[place], 1), avg), starts) if len(starts) else np.zeros(0)
    edges = pa.array(np.concatenate([starts, [len(code), len(code)]]).astype(np.int32))
    lists = lambda values: pa.ListArray.from_arrays(edges, pa.array(values, pa.int32()))
    n = len(starts)
    own = pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [len(ids)], pa.int32()), pa.array([ids[i] for i in order], kind))
    counts = np.append(np.diff(np.append(starts, len(code))), len(ids))
    columns = {
        "term": pa.concat_arrays([terms, pa.nulls(1, terms.type)]),
        "zone": pa.array(np.full(n + 1, name)),
        "n": pa.array(counts.astype(np.int32)),
        "best": pa.array(np.append(best, 0.0)),
        "zone_avg": pa.array(np.full(n + 1, avg)),
        "zone_tokens": pa.array(np.append(np.zeros(n, np.int64), dl.sum())),
        "places": lists(place), "tfs": lists(tf), "dls": lists(dl[place]), "chunks": own,
    }
    return pa.RecordBatch.from_pydict(columns)


def _in_zones(kind: pa.DataType):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, tokens, size = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for chunk, found in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(chunk)
                tokens.append(found.values)
                size += len(found.values)
                if len(ids) >= ZONE_CHUNKS or size >= ZONE_TOKENS:
                    yield _zone_blocks(name, ids, tokens, kind)
                    name, ids, tokens, size = name + 1, [], [], 0
        if ids:
            yield _zone_blocks(name, ids, tokens, kind)

    return cut


@dataclass(frozen=True)
class Search:
    """``results``: (query_id, chunk_id, score, rank). ``zones``: (query_id, zone, bound, read) of every zone that holds a term of a question."""

    results: DataFrame
    zones: DataFrame


class PostingStore:
    """An index in a folder that all executors share; one writer at a time, any number of readers.

    Chunk ids are unique over all batches. A chunk without tokens counts for the averages and is never found.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def append(self, chunks: DataFrame, text: str = "text", key: str = "chunk_id") -> PostingStore:
        """Adds a batch of chunks; nothing that is stored is read or written again. A batch that fails leaves the index as it was."""
        rows = chunks.select(F.col(key).alias("chunk_id"), tokens_of(F.col(text)).alias("tokens"))
        kind = rows.schema["chunk_id"].dataType.simpleString()
        blocks = rows.mapInArrow(_in_zones(to_arrow_type(rows.schema["chunk_id"].dataType)), f"{STORED}, chunks array<{kind}>")
        bucket = F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(BUCKETS))).cast("int")
        batch = uuid.uuid4().hex
        dealt = blocks.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "term", "zone")
        dealt.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.folder}/blocks/{batch}")
        done = self.spark.read.schema(dealt.schema).parquet(f"{self.folder}/blocks/{batch}").where("bucket = -1")
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(out) for c, out in (("n", "n_chunks"), ("zone_tokens", "n_tokens"))]
        row = done.agg(F.lit(batch).alias("batch"), F.lit(kind).alias("chunk_type"), *sums)
        row.write.mode("append").parquet(f"{self.folder}/batches")
        return self

    def batches(self) -> list[Row]:
        """One row for each append that was written to its end."""
        return self.spark.read.schema(BATCHES).parquet(f"{self.folder}/batches").collect()

    @property
    def stats(self) -> DataFrame:
        """n_chunks, avg_len: one row."""
        n, tokens = _totals(self.batches())
        return self.spark.range(1).select(F.lit(n).alias("n_chunks"), F.lit(tokens / n if n else None).cast("double").alias("avg_len"))

    def _rows(self, condition: Column, batches: list[Row] | None = None) -> DataFrame:
        """Stored rows, zones with names that are unique over the batches."""
        out = None
        for b in self.batches() if batches is None else batches:
            rows = self.spark.read.schema(f"{STORED}, chunks array<{b.chunk_type}>, bucket int").parquet(f"{self.folder}/blocks/{b.batch}").where(condition)
            rows = rows.withColumn("zone", F.concat(F.lit(f"{b.batch}-"), F.col("zone").cast("string")))
            out = rows if out is None else out.unionAll(rows)
        return out

    def blocks(self) -> DataFrame:
        """(bucket, term, zone, n, best, zone_avg, places, tfs, dls); only the columns that are asked for are read."""
        return self._rows(F.col("bucket") >= 0).drop("chunks", "zone_tokens")

    def zones(self, batches: list[Row] | None = None) -> DataFrame:
        """(zone, chunks): the ids of each zone's chunks in order of place."""
        return self._rows(F.col("bucket") == -1, batches).select("zone", "chunks")

    @property
    def terms(self) -> DataFrame:
        """(term, df), from the heads of the blocks."""
        return self.blocks().groupBy("term").agg(F.sum("n").alias("df"))

    @property
    def postings(self) -> DataFrame:
        """(chunk_id, term, tf, dl), one row for each posting."""
        flat = self.blocks().select("zone", "term", F.explode(F.arrays_zip("places", "tfs", "dls")).alias("p"))
        ids = self.zones().select("zone", F.posexplode("chunks").alias("place", "chunk_id"))
        flat = flat.select("zone", F.col("p.places").alias("place"), "term", F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))
        return flat.join(ids, ["zone", "place"]).select("chunk_id", "term", "tf", "dl")

    def search(self, terms: DataFrame, k: int, key: str = "query_id", kinds: DataFrame | None = None) -> Search:
        """The best ``k`` chunks for the questions of ``terms`` (key, term, qf and, if ``kinds`` are given, want).

        kinds: (chunk_id, chunk_type); a question that wants a type gets chunks of that type alone. The result is exact: equal to
        scoring every posting, scores equal at nine digits in order of chunk id.
        """
        batches = self.batches()
        n, tokens = _totals(batches)
        avg = max(1.0, tokens / n) if n else 1.0
        terms = cut_lineage(terms.withColumn("_at", F.pmod(F.xxhash64("term"), F.lit(BUCKETS))))
        asks = terms.agg(F.count_distinct(key).alias("n"), F.collect_set("_at").alias("at")).first()  # at most BUCKETS numbers
        # files of other buckets aren't opened; the blocks of other terms go no further than the scan
        blocks = self._rows(F.col("bucket").isin(asks["at"] or [-2]), batches).join(terms.select("term").distinct(), "term", "left_semi")
        # an impact grows by less than the factor by which the average length has grown
        most = F.col("best") * F.greatest(F.lit(1.0), F.lit(avg) / F.col("zone_avg"))
        shares, zones = max(1, -(-asks["n"] // (SHARE * QUESTIONS))), self.zones(batches).count() if batches else 0
        groups = max(1, -(-zones // GROUP), min(zones, -(-TASKS // shares)))
        group = F.pmod(F.xxhash64("zone"), F.lit(groups)).alias("_g")
        blocks = cut_lineage(blocks.select("term", "zone", group, "n", most.alias("most"), "places", "tfs", "dls"))
        df = blocks.groupBy("term").agg(F.sum("n").alias("df"))
        weight = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("qf")
        asked = cut_lineage(terms.join(df, "term").withColumns({"weight": weight, "_q": F.pmod(F.xxhash64(key), F.lit(shares))}).drop("_at", "qf", "df"))
        wants = [F.first("want").alias("want")] if "want" in asked.columns else []
        lists = asked.where(F.col(key).isNotNull()).groupBy(key, "_q").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("t"), *wants)
        lists = cut_lineage(lists.select(key, "_q", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"), *["want" for _ in wants]))
        wanted = cut_lineage(asked.select("_q", "term").distinct())
        kind = lists.schema[key].dataType.simpleString()
        heads = blocks.select("_g", "zone", "term", "most").join(wanted, "term")
        rows = lists.select(key, "_q", "terms", "weights", F.explode(F.sequence(*[F.lit(x).cast("long") for x in (0, groups - 1)])).alias("_g"))
        rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])

        def bound(heads: pa.Table, rows: pa.Table) -> pa.Table:
            return _zone_bounds(heads, rows, key)

        bounds = heads.groupBy("_g", "_q").cogroup(rows.groupBy("_g", "_q")).applyInArrow(bound, f"{key} {kind}, _q long, _g long, zone string, bound double")
        bounds = cut_lineage(top_k(bounds, [key], [F.col("bound").desc(), F.col("zone")], None, "_place"))
        first = bounds.where(F.col("_place") <= PROBED)

        def scored(pairs: DataFrame) -> DataFrame:
            return self._scored(pairs, lists, wanted, blocks, batches, avg, k, key, kinds)

        found = cut_lineage(scored(first.withColumn("_least", F.lit(None).cast("double"))))
        least = top_k(found, [key], [F.col("score").desc(), F.col("chunk_id")], k).where(F.col("rank") == k).select(key, F.col("score").alias("_least"))
        rest = bounds.where(F.col("_place") > PROBED).join(least, key, "left")
        reaches = F.col("_least").isNull() | (F.col("bound") * (1 + SLACK) + SLACK >= F.col("_least"))
        rest = rest.withColumn("read", reaches)
        results = top_k(found.unionByName(scored(rest.where("read"))), [key], [F.col("score").desc(), F.col("chunk_id")], k)
        return Search(results, first.withColumn("read", F.lit(True)).select(key, "zone", "bound", "read").unionByName(rest.select(key, "zone", "bound", "read")))

    def boosted(self, terms: DataFrame, inside: DataFrame, digits: DataFrame, fixed: DataFrame, k: int, key: str = "query_id") -> DataFrame:
        """(key, chunk_id, score): the best ``k`` of each (question, zone) by BM25 and boosts, among chunks that match at all.

        terms: (key, term, qf). inside: (needle, term), stored terms that contain a term of a question. digits: (key, digits), numbers
        in a question. fixed: (chunk_id, extra, digits) of the chunks that may be found; ids are unique there and in the store.
        Scores add up in one array for a zone and at most QUESTIONS questions, about; pairs of question and chunk are never rows.
        """
        batches = self.batches()
        n, tokens = _totals(batches)
        avg = max(1.0, tokens / n) if n else 1.0
        rows = terms.join(self.terms.join(terms.select("term").distinct(), "term", "left_semi"), "term", "left")
        weight = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("qf")
        none = F.lit(None).cast("string")
        rows = rows.select(key, F.struct("term", weight.alias("weight")).alias("t"), none.alias("d"))
        rows = rows.unionByName(digits.select(key, F.lit(None).cast(rows.schema["t"].dataType).alias("t"), F.col("digits").alias("d")))
        asked = rows.groupBy(key).agg(F.array_sort(F.collect_list("t")).alias("t"), F.collect_set("d").alias("digits"))
        asked = cut_lineage(asked.select(key, F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"), "digits"))
        shares = max(1, -(-asked.count() // QUESTIONS))
        asked = asked.withColumn("_q", F.pmod(F.xxhash64(key), F.lit(shares)).cast("int"))
        needles = asked.select("_q", F.explode("terms").alias("needle")).distinct()
        wanted = needles.join(inside, "needle").groupBy("_q", "term").agg(F.collect_set("needle").alias("needles"))
        ids = self.zones(batches).select("zone", F.posexplode("chunks").alias("place", "chunk_id"))
        own = ids.join(fixed, "chunk_id").groupBy("zone").agg(F.array_sort(F.collect_list(F.struct("place", "extra", "digits"))).alias("l"))
        own = cut_lineage(own)
        empty = F.array().cast("array<int>")
        listed = own.select(
            "zone", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("_q"), none.alias("term"), F.col("l.place").alias("places"), empty.alias("tfs"), empty.alias("dls"),
            F.lit(None).cast("array<string>").alias("needles"), F.col("l.extra").alias("extras"), F.col("l.digits").alias("digits"),
        )
        blocks = self._rows(F.col("bucket") >= 0, batches).select("term", "zone", "places", "tfs", "dls").join(wanted, "term")
        blocks = blocks.withColumns({"extras": F.lit(None).cast("array<double>"), "digits": F.lit(None).cast("array<string>")})
        asked = asked.crossJoin(own.select("zone")).select(*[F.col(c).alias(c) for c in (*asked.columns, "zone")])

        def score(blocks: pa.Table, rows: pa.Table) -> pa.Table:
            return _boosted_places(blocks, rows, k, key, avg)

        kind = asked.schema[key].dataType.simpleString()
        both = blocks.unionByName(listed).groupBy("zone", "_q").cogroup(asked.groupBy("zone", "_q"))
        best = both.applyInArrow(score, f"{key} {kind}, zone string, place int, score double")
        return best.join(self.zones(batches), "zone").select(key, F.get("chunks", F.col("place")).alias("chunk_id"), "score")

    def _scored(
        self, pairs: DataFrame, lists: DataFrame, wanted: DataFrame, blocks: DataFrame, batches: list[Row], avg: float, k: int, key: str, kinds: DataFrame | None
    ) -> DataFrame:
        """(key, chunk_id, score): at least the best ``k`` of each (question, group of zones) among ``pairs`` (key, _q, _g, zone, _least).

        A question goes once to a group, with all its terms; a block goes to the shares of questions that read its zone and ask for its term.
        """
        read = pairs.select("zone", "_q").distinct()
        rows = pairs.groupBy(key, "_q", "_g").agg(F.collect_list("zone").alias("zones"), F.max("_least").alias("least")).join(lists, [key, "_q"])
        rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])
        none = F.lit(None).cast("array<string>")
        own = blocks.select("term", "zone", "_g", "places", "tfs", "dls").join(read, "zone").join(wanted, ["_q", "term"], "left_semi").withColumn("kinds", none)
        if kinds is not None:
            ids = self.zones(batches).select("zone", F.posexplode("chunks").alias("place", "chunk_id"))
            ids = ids.join(kinds.select("chunk_id", F.col("chunk_type").cast("string").alias("kind")), "chunk_id", "left")
            listed = ids.groupBy("zone").agg(F.array_sort(F.collect_list(F.struct("place", "kind"))).alias("l"))
            empty = F.array().cast("array<int>")
            listed = listed.join(pairs.select("zone", "_q", "_g").distinct(), "zone").select(
                "zone", "_q", "_g", F.lit(None).cast("string").alias("term"), *[empty.alias(c) for c in ("places", "tfs", "dls")], F.transform("l", lambda x: x["kind"]).alias("kinds")
            )
            own = own.unionByName(listed)

        def score(blocks: pa.Table, rows: pa.Table) -> pa.Table:
            return _group_scores(blocks, rows, k, key, avg)

        kind = lists.schema[key].dataType.simpleString()
        best = own.groupBy("_g", "_q").cogroup(rows.groupBy("_g", "_q")).applyInArrow(score, f"{key} {kind}, zone string, place int, score double")
        return best.join(self.zones(batches), "zone").select(key, F.get("chunks", F.col("place")).alias("chunk_id"), "score")


def _totals(batches: list[Row]) -> tuple[int, int]:
    return sum(b.n_chunks for b in batches), sum(b.n_tokens for b in batches)


def _terms_of(rows: pa.Table, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in ``terms``, weight) of every term of ``rows`` that is there, once a row, row by row."""
    who = np.repeat(np.arange(rows.num_rows), pa.compute.list_value_length(rows.column("terms")).to_numpy())
    at = pa.compute.index_in(pa.compute.list_flatten(rows.column("terms").combine_chunks()), terms)
    has = at.is_valid().to_numpy(zero_copy_only=False)
    weight = pa.compute.list_flatten(rows.column("weights").combine_chunks()).to_numpy()[has]
    pair, same = np.unique(who[has] * np.int64(max(1, len(terms))) + at.drop_null().to_numpy(), return_inverse=True)
    return *np.divmod(pair, max(1, len(terms))), np.bincount(same, weight, len(pair))


def _zone_bounds(heads: pa.Table, rows: pa.Table, key: str) -> pa.Table:
    """(key, _q, _g, zone, bound) of every zone of ``heads`` that holds a term of a question of ``rows``."""
    names = [key, "_q", "_g", "zone", "bound"]
    kinds = [rows.schema.field(key).type, pa.int64(), pa.int64(), pa.string(), pa.float64()]
    if not heads.num_rows or not rows.num_rows:
        return pa.table([pa.array([], t) for t in kinds], names)
    term, zone = (heads.column(c).combine_chunks().dictionary_encode() for c in ("term", "zone"))
    most = np.zeros((len(zone.dictionary), len(term.dictionary)))
    most[zone.indices.to_numpy(), term.indices.to_numpy()] = heads.column("most").to_numpy()
    who, at, weight = _terms_of(rows, term.dictionary)
    bound = np.stack([np.bincount(who, weight * m[at], rows.num_rows) for m in most])
    z, q = np.nonzero(bound > 0)
    same = lambda c: pa.array(np.full(len(q), heads.column(c)[0].as_py(), np.int64))
    return pa.table([rows.column(key).take(pa.array(q)), same("_q"), same("_g"), zone.dictionary.take(pa.array(z)), pa.array(bound[z, q])], names)


def _group_scores(blocks: pa.Table, rows: pa.Table, k: int, key: str, avg: float) -> pa.Table:
    """(key, zone, place, score) of at least the best ``k`` places in ``zones`` for every question of ``rows``, added up term by term.

    ``least`` is a score that a question has k times already, or null; what lies below it goes, as does what k places of the group pass.
    """
    names = [key, "zone", "place", "score"]
    if not blocks.num_rows or not rows.num_rows:
        return pa.table([pa.array([], t) for t in (rows.schema.field(key).type, pa.string(), pa.int32(), pa.float64())], names)
    zone, term = (blocks.column(c).combine_chunks().dictionary_encode() for c in ("zone", "term"))
    in_zone, codes = zone.indices.to_numpy(), term.indices.fill_null(-1).to_numpy()
    ends = np.cumsum(pa.compute.list_value_length(blocks.column("places")).to_numpy().astype(np.int64))
    begins = np.concatenate([[0], ends[:-1]])
    places, tfs, dls = (pa.compute.list_flatten(blocks.column(c)).to_numpy() for c in ("places", "tfs", "dls"))
    part = impact(tfs.astype(np.float64), np.maximum(dls, 1), avg)
    who, at, weight = _terms_of(rows, term.dictionary)
    edges = np.searchsorted(who, np.arange(rows.num_rows + 1))
    readers = np.repeat(np.arange(rows.num_rows), pa.compute.list_value_length(rows.column("zones")).to_numpy())
    reads = pa.compute.index_in(pa.compute.list_flatten(rows.column("zones").combine_chunks()), zone.dictionary).fill_null(-1).to_numpy()
    wants = np.array(rows.column("want").to_pylist() if "want" in rows.column_names else [None] * rows.num_rows, object)
    least = rows.column("least").fill_null(-np.inf).to_numpy().copy()
    kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # row, zone, place, score
    for z in range(len(zone.dictionary)):
        own, asking = np.flatnonzero(in_zone == z), np.sort(readers[reads == z])
        block = np.full(len(term.dictionary), -1)
        block[codes[own[codes[own] >= 0]]] = own[codes[own] >= 0]
        width = max((int(places[begins[b] : ends[b]].max(initial=-1)) for b in own.tolist()), default=-1) + 1
        listed = own[codes[own] < 0]
        kinds = np.array(blocks.column("kinds")[int(listed[0])].as_py()[:width], object) if len(listed) else None
        new = [kept]
        for i in range(0, len(asking) if width else 0, QUESTIONS):
            some = asking[i : i + QUESTIONS]
            scores = np.zeros((len(some), width))
            span, local = slice(edges[some[0]], edges[some[-1] + 1]), np.full(rows.num_rows, -1)
            local[some] = np.arange(len(some))
            j, b, w = local[who[span]], block[at[span]], weight[span]
            order = np.argsort(b, kind="stable")
            order = order[(j[order] >= 0) & (b[order] >= 0)]
            j, b, w = j[order], b[order], w[order]
            cuts = [*np.flatnonzero(np.diff(b, prepend=-1)).tolist(), len(b)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):  # a term, with all questions that ask for it
                p = slice(begins[b[x]], ends[b[x]])
                scores[np.ix_(j[x:y], places[p])] += np.outer(w[x:y], part[p])
            for j in [j for j, q in enumerate(some.tolist()) if kinds is not None and wants[q] is not None]:
                scores[j, kinds != wants[some[j]]] = 0
            floor = least[some]
            if np.isinf(floor).any():
                j, place = _best_places(np.round(scores, 9), scores > 0, k)
            else:
                j, place = np.nonzero(scores > np.maximum(floor - SLACK, 0)[:, None])
            score = np.round(scores[j, place], 9)
            good = score >= floor[j]
            new.append([some[j[good]], np.full(good.sum(), z), place[good], score[good]])
        kept, least = _best_rows([np.concatenate(c) for c in zip(*new, strict=True)], least, k)
    row, at, place, score = kept
    return pa.table([rows.column(key).take(pa.array(row)), zone.dictionary.take(pa.array(at)), pa.array(place.astype(np.int32)), pa.array(score)], names)


def _best_rows(found: list[np.ndarray], least: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Of ``found`` (row, zone, place, score) those that fewer than ``k`` of their row surpass, and the raised ``least`` scores of the rows."""
    order = np.lexsort((-found[3], found[0]))
    found = [c[order] for c in found]
    row, score = found[0], found[3]
    kth = np.arange(len(row)) - np.searchsorted(row, row) == k - 1
    least = least.copy()
    least[row[kth]] = np.maximum(least[row[kth]], score[kth])
    good = score >= least[row]
    return [c[good] for c in found], least


def _best_places(scores: np.ndarray, some: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` best scores of every row among ``some``; equal ones by column."""
    scores = np.where(some, scores, -np.inf)
    n = min(k, scores.shape[1])
    cut = -np.partition(-scores, n - 1, axis=1)[:, n - 1]
    q, place = np.nonzero((scores >= cut[:, None]) & some)
    order = np.lexsort((place, -scores[q, place], q))
    q, place = q[order], place[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[kept], place[kept]


def _boosted_places(blocks: pa.Table, rows: pa.Table, k: int, key: str, avg: float) -> pa.Table:
    """(key, zone, place, score) of the best ``k`` listed places for every question of ``rows``, all boosts added."""
    names = [key, "zone", "place", "score"]
    lists = lambda c: (pa.compute.list_value_length(blocks.column(c)).fill_null(0).to_numpy().astype(np.int64), pa.compute.list_flatten(blocks.column(c)).to_numpy())
    listed = np.flatnonzero(blocks.column("term").is_null().to_numpy()) if blocks.num_rows else []
    if not len(listed) or not rows.num_rows:
        return pa.table([pa.array([], rows.schema.field(key).type), pa.array([], pa.string()), pa.array([], pa.int32()), pa.array([], pa.float64())], names)
    blocks, rows = blocks.combine_chunks(), rows.combine_chunks()
    at = int(listed[0])
    own = np.array(blocks.column("places")[at].as_py())
    extra = np.array(blocks.column("extras")[at].as_py())
    (sizes, places), (_, tfs), (_, dls) = (lists(c) for c in ("places", "tfs", "dls"))
    sizes[at] = 0
    places = np.concatenate([places[: (start := int(lists("places")[0][:at].sum()))], places[start + len(own) :]])
    column = np.full(max(int(own.max()), int(places.max(initial=0))) + 1, -1)
    column[own] = np.arange(len(own))
    # postings of places that aren't listed go
    at_column = column[places]
    ends = np.concatenate([[0], np.cumsum(at_column >= 0)])[np.concatenate([[0], np.cumsum(sizes)])]
    part = impact(tfs.astype(np.float64), np.maximum(dls, 1), avg)[at_column >= 0]
    at_column = at_column[at_column >= 0]
    spans = [slice(a, b) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    block = {t: i for i, t in enumerate(blocks.column("term").to_pylist()) if t is not None}
    # every (needle, column) once, in order: all postings of the terms that hold a needle
    counts, numbered = pa.compute.list_value_length(blocks.column("needles")).fill_null(0).to_numpy(), {}
    needles, holder = pa.compute.list_flatten(blocks.column("needles")).combine_chunks().dictionary_encode(), np.repeat(np.arange(len(counts)), counts)
    n = np.diff(ends)[holder]
    code = np.repeat(needles.indices.to_numpy().astype(np.int64) * len(own), n)
    code += at_column[np.arange(n.sum()) + np.repeat(ends[:-1][holder] - np.cumsum(n) + n, n)]
    code = np.unique(code)
    edges = np.searchsorted(code, np.arange(len(needles.dictionary) + 1) * len(own)).tolist()
    holds = {t: code[edges[i] : edges[i + 1]] - i * len(own) for i, t in enumerate(needles.dictionary.to_pylist())}
    for i, d in enumerate(blocks.column("digits")[at].as_py()):
        if d is not None:
            numbered.setdefault(d, []).append(i)
    score, matched = np.zeros((rows.num_rows, len(own))), np.zeros((rows.num_rows, len(own)), bool)
    asked = (rows.column(c).to_pylist() for c in ("terms", "weights", "digits"))
    for q, (terms, weights, digits) in enumerate(zip(*asked, strict=True)):
        for t, w in zip(terms, weights, strict=True):
            if w is not None and t in block:
                score[q, at_column[spans[block[t]]]] += w * part[spans[block[t]]]
        matched[q] = score[q] > 0
        inside, number = np.zeros(len(own), bool), np.zeros(len(own), bool)
        for t in terms:
            inside[holds.get(t, [])] = True
        for d in digits:
            number[numbered.get(d, [])] = True
        matched[q] |= inside | number
        score[q] += fv.BOOST_SUBSTRING * inside + fv.BOOST_NUMBER * number + extra
    q, c = _best_places(np.round(score, 9), matched & (score > 0), k)
    zone = blocks.column("zone").combine_chunks().take(pa.array(np.zeros(len(q), np.int64)))
    return pa.table([rows.column(key).take(pa.array(q)), zone, pa.array(own[c].astype(np.int32)), pa.array(score[q, c])], names)
