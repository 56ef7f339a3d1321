"""Exact duplicates through a persistent digest index (native).

The index is a table bucketed and sorted by digest. A batch of documents is reduced to one row per digest before
anything is joined; a sort-merge anti-join with the index leaves the digests that are new, which are appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.llm.common import table
from litmill.session import cut_lineage, ensure_checkpoint_dir

BUCKETS = 64
SCHEMA = "digest binary, keep_id long, group_size long"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


class DigestIndex:
    """A bucketed table (digest, keep_id, group_size) that later batches are checked against.

    ``folder`` holds its files; it must be shared by all executors. ``group_size`` counts the rows of the batch that
    brought the digest.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str, buckets: int = BUCKETS):
        self.spark, self.name, self.folder, self.buckets = spark, name, folder, buckets
        if not spark.catalog.tableExists(name):
            self._append(spark.createDataFrame([], SCHEMA))

    def _append(self, rows: DataFrame) -> None:
        w = rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append")
        w.option("path", self.folder).saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Those of ``groups`` that the index lacks: a sort-merge anti-join that reads the index by bucket, without a shuffle."""
        known = self.rows().select("digest").hint("merge")
        return groups.join(known, "digest", "left_anti").select("digest", "keep_id", "group_size")

    def add(self, groups: DataFrame) -> DataFrame:
        """Appends the digests that the index lacks, and returns them; ``groups`` has one row per digest."""
        # the scan of the index ends before the append begins, so that no task reads files of the same batch
        new = cut_lineage(self.unseen(groups))
        self._append(new.repartition(self.buckets, "digest"))
        return new

    def known(self, groups: DataFrame) -> DataFrame:
        """The index's rows of the digests of ``groups``; the index is read by bucket, without a shuffle."""
        return self.rows().join(groups.select("digest").hint("merge"), "digest", "left_semi")


def exact_dedup(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text; other columns are ignored), after adding them to ``index``.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the one with the most code points, then the
    smallest doc_id, stays; a digest that was in the index before keeps its earlier document and none of the batch.
    Null and empty texts are equal to texts of white space. A null doc_id comes after all others, and is kept where its
    group has no other. Rows that repeat an id and a text count as one document each: all of them are ``kept`` if one is.
    An empty table gives no rows.
    """
    rows = cut_lineage(
        docs.select(
            "doc_id",
            F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest"),
            F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("_points"),
        )
    )
    first = F.struct(-F.col("_points"), F.col("doc_id").isNull(), F.col("doc_id"))
    groups = cut_lineage(rows.groupBy("digest").agg(F.min_by("doc_id", first).alias("keep_id"), F.count("*").alias("group_size")))
    new = index.add(groups).select("digest", F.lit(True).alias("_new"))
    # the batch's digests alone, as plain files: a join with the rows shuffles both sides, so that Spark can split a hot digest
    known = cut_lineage(index.known(groups).join(new, "digest", "left"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.coalesce("_new", F.lit(False))
    out = rows.join(known, "digest")
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against an index that starts empty, so that the answer depends on the table alone."""
    run = uuid.uuid4().hex
    index = DigestIndex(spark, f"llm_digests_{run}", f"{ensure_checkpoint_dir(spark)}/digests-{run}")
    return exact_dedup(table(spark, sf_dir, "documents", "doc_id", "text"), index)


SQL_OP5 = r"""with d as (
  select doc_id, length(coalesce(text, '')) as points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
       doc_id = first_value(doc_id) over w as kept, text_sha256
from d window w as (partition by text_sha256 order by points desc, doc_id)"""
