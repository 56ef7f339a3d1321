"""Mixing sources to target weights by weighted fair queueing.

Every source is shuffled by a hash of its ids. A document's virtual finish time is its source's words so far divided
by the source's target; repeats go on counting in the next epoch. All entries are sorted by finish time over all
sources, and the mix is the part of that order within the total budget: at time 1 every source has its target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.llm.common import WORD, prefix_sums, table
from litmill.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE, REPEATS = 1.5, 2


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) of ``sized`` (source, size).

    Sources in code-point order, null last, weigh ``weights``, repeating. They share ``share`` times all sizes; a target
    stops at ``repeats`` times its source, the excess goes to the others by weight. In the order of cap / weight the level
    of the first source that isn't full is the largest of (budget - caps before) / (weights from here on), so the level
    is a maximum over prefix sums. One row per source goes through the sums.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sums = sums.withColumn("_null", F.col("source").isNull().cast("int")).withColumn("_one", F.lit(1))
    ranked = prefix_sums(sums, [], ["_null", "source"], {"_rank": "_one"})
    at = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    full = ranked.withColumn("_w", at.cast("long")).withColumn("_cap", F.col("source_size") * repeats)
    full = cut_lineage(full.withColumn("_ratio", F.col("_cap") / F.col("_w")))
    along = prefix_sums(full, [], ["_ratio", "_rank"], {"_caps": "_cap", "_ws": "_w"})
    words, weight = full.agg(F.sum("source_size"), F.sum("_w")).first()
    level = along.agg(F.max((F.lit(share * (words or 0)) - F.col("_caps")) / (F.lit(weight or 0) - F.col("_ws")))).first()[0]
    target = F.least(F.col("_cap").cast("double"), F.lit(level) * F.col("_w"))
    return full.select("source", "source_size", target.alias("target"))


def fair_mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = "mix"
) -> tuple[DataFrame, DataFrame]:
    """(sized, mix) of ``docs`` (doc_id, text, source and any others but names that begin with "_").

    ``sized``: the documents' ids with _row, _mark (a hash of the text), size, source_size, target. ``mix``: the entries in the mix, one per document and
    epoch, sorted by ``finish`` over all sources: row, epoch, finish, words, and position (words of the mix before it). The
    entry that a source's target cuts gives only the words up to it, so each source gives floor(target) words. Null texts
    have no words; documents without words, and sources of such, are in no entry. A null source is a source of its own; null
    ids are shuffled like an empty id. An empty table gives two empty tables. Rows that repeat are documents of their own.
    """
    n = F.monotonically_increasing_id()
    sized = cut_lineage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), n.alias("_row"), F.xxhash64("text").alias("_mark")))
    goal = cut_lineage(targets(sized, weights, share, repeats))
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = prefix_sums(sized.withColumn("_place", place), ["source"], ["_place", "doc_id", "_row"], {"_start": "size"})
    # the side of the targets is one row per source; beyond Spark's own limit for broadcasts the hot source is split by AQE
    g = goal.withColumnRenamed("source", "_source")
    sized = cut_lineage(rows.join(g, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_place"))
    entries = sized.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    start = F.col("_start") + F.col("epoch") * F.col("source_size")
    words = F.least(F.col("size"), F.floor("target") - start)
    mix = entries.select("_row", "epoch", F.try_divide(start + F.col("size"), F.col("target")).alias("finish"), words.alias("words")).where("words > 0")
    return sized, prefix_sums(mix, [], ["finish", "_row", "epoch"], {"position": "words"})


def op8_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, mix = fair_mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    taken = mix.groupBy("_row").agg(F.sum("words").alias("taken"))
    out = sized.join(taken, "_row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


SQL_OP8 = r"""with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as r from d group by source),
w as (select *, [3, 1, 2][r % 3 + 1] as w, source_size * 2 as cap from s),
l as (select (1.5 * sum(source_size) over () - (sum(cap) over o - cap))::double / (sum(w) over () - (sum(w) over o - w)) as level
  from w window o as (order by cap::double / w, r rows unbounded preceding)),
t as (select source, source_size, least(cap::double, (select max(level) from l) * w) as target from w),
c as (select d.doc_id, d.size, t.source_size, t.target,
    sum(d.size) over (partition by d.source order by md5('mix:' || d.doc_id), d.doc_id rows unbounded preceding) - d.size as start
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - start - source_size)))::bigint as taken
from c"""
