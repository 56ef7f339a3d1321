"""From raw documents to packed sequences, in stages; each reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.llm.jaccard_join import similarity_components
from litmill.llm.language_id import fit, identify
from litmill.llm.line_dedup import line_dedup
from litmill.llm.mixing import fair_mix
from litmill.llm.packing import pack_documents
from litmill.session import cut_lineage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; learnt from the labelled ones. Texts without a letter go."""
    judged = identify(docs.select("*", F.col("lang").alias("_lang")), fit(docs.select("doc_id", "text", "lang")))
    return judged.where(~F.col("rejected")).select(*docs.columns)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the first alone; n_chars follows the text."""
    cut = line_dedup(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return cut.select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id. Rows that repeat an id are one document, its longest text."""
    found = similarity_components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")) | F.col("component_id").isNull())
    kept = found.select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
    rows = rows.withColumn("_alone", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    best = F.max_by(F.struct(*docs.columns), F.struct(F.coalesce(F.char_length("text"), F.lit(-1)), "text"))
    return rows.groupBy("doc_id", "_alone").agg(best.alias("_row")).select("_row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes their words: a part of at least one half counts as a copy. Documents without words go."""
    sized, mix = fair_mix(docs)
    words = mix.groupBy("_row").agg(F.sum("words").alias("_taken"))
    copies = sized.join(words, "_row").withColumn("_copies", F.floor(F.col("_taken") / F.col("size") + 0.5))
    copies = cut_lineage(copies.groupBy("doc_id", "_mark").agg(F.sum("_copies").alias("_copies")).where("_copies > 0").withColumnRenamed("doc_id", "_id"))
    rows = docs.withColumn("_text", F.xxhash64("text"))
    rows = rows.join(copies, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_mark")))
    one = rows.groupBy("doc_id", "_mark").agg(F.first(F.struct(*docs.columns)).alias("_row"), F.first("_copies").alias("_copies"))
    return one.select("_row.*", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences. The workers serve the other stages too, so they keep fewer words."""
    return pack_documents(docs, known_words=50_000)


STAGES = [
    ("language", known_language),
    ("lines", unique_lines),
    ("near_duplicates", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]

# a classifier, similarity joins and a tokenizer are beyond SQL: tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
