"""Sinks and exports: nested chat JSON, vectors, graphs, conversation documents, history rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.functions.skew import numbered
from litmill.functions.text import start_of

TURN_SCHEMA = (
    "turn_id bigint, timestamp string, user_query string, assistant_response string, retrieval_score double, "
    "response_valid boolean, response_citations array<string>, error_message string, document_id string"
)


def write_turns(turns: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON line per turn, nested fields kept; files are split by Spark, not by conversation."""
    turns.write.mode(mode).json(path)


def read_turns(spark: SparkSession, path: str, schema: str = "conv_id bigint, " + TURN_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def save_vectors(vectors: DataFrame, path: str, mode: str = "overwrite") -> None:
    vectors.write.mode(mode).parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Node and edge tables, partitioned by type so that readers of one type prune the rest."""
    nodes.write.mode(mode).partitionBy("type").parquet(f"{path}/nodes")
    edges.write.mode(mode).partitionBy("type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def conversation_markdown(turns: DataFrame, part_turns: int = 500) -> DataFrame:
    """(conv_id, part_no, markdown): conversations as markdown documents.

    turns: conv_id, turn, user_query, assistant_response, retrieval_score and optionally timestamp,
    citations (array), error_message, document_id. A document is its parts in order; a part holds at
    most ``part_turns`` turns, so no conversation, however long, is gathered in one task.
    """
    have = turns.columns
    empty = F.lit("")
    stamp = F.concat(F.lit("*"), F.coalesce(F.col("timestamp"), empty), F.lit("*\n\n")) if "timestamp" in have else empty
    cited = (
        F.when(F.size("citations") > 0, F.concat(F.lit("📚 **Citations**: "), F.array_join("citations", ", "), F.lit("\n"))).otherwise(empty)
        if "citations" in have
        else empty
    )
    error = (
        F.when(F.coalesce(F.col("error_message"), empty) != "", F.concat(F.lit("⚠️ **Error**: "), F.col("error_message"), F.lit("\n"))).otherwise(empty)
        if "error_message" in have
        else empty
    )
    block = F.concat(
        F.lit("## Turn "), F.col("turn").cast("string"), F.lit("\n"), stamp,
        F.lit("### 👤 User\n"), F.coalesce(F.col("user_query"), empty), F.lit("\n\n### 🤖 Assistant\n"),
        F.coalesce(F.col("assistant_response"), empty), F.lit("\n\n"), cited,
        F.lit("📊 **Score**: "), F.format_string("%.3f", F.col("retrieval_score")), F.lit("\n"), error, F.lit("\n---\n\n"),
    )
    document = (
        F.concat(F.lit("**Document**: "), F.col("document_id"), F.lit("\n\n")) if "document_id" in have else empty
    )
    parts = turns.withColumn("block", block).groupBy(
        "conv_id", F.floor(F.col("turn") / part_turns).cast("int").alias("part_no")
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))), lambda t: t["block"]), "")
    return parts.agg(body.alias("body"), F.max(document).alias("document")).select(
        "conv_id",
        "part_no",
        F.when(
            F.col("part_no") == 0,
            F.concat(F.lit("# Chat History - "), F.col("conv_id").cast("string"), F.lit("\n\n"), F.coalesce("document", empty), F.lit("---\n\n"), F.col("body")),
        )
        .otherwise(F.col("body"))
        .alias("markdown"),
    )


def combine_sources(results: DataFrame, limit_chars: int | None = None) -> DataFrame:
    """(query_id, combined, urls, n_sources): provider texts under source headers.

    results: query_id, source, pos, text, url; one row per query and provider.
    """
    used = results.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    url = F.coalesce(F.col("url"), F.lit(""))
    block = F.concat(
        F.lit("["), F.col("source"), F.lit("]"), F.when(url != "", F.concat(F.lit(" — "), url)).otherwise(""),
        F.lit("\n"), start_of(F.col("text"), limit_chars),
    )
    rows = used.select("query_id", F.struct("pos", "source", block.alias("block"), url.alias("url")).alias("s"))
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return listed.select(
        "query_id",
        F.array_join(F.transform("s", lambda x: x["block"]), "\n\n").alias("combined"),
        F.filter(F.transform("s", lambda x: x["url"]), lambda u: u != "").alias("urls"),
        F.size("s").alias("n_sources"),
    )


def with_history_ids(rows: DataFrame, order: list[str], bucket, first_id: int = 1) -> DataFrame:
    """Consecutive ids from ``first_id`` in ``order``, without sorting all rows in one task."""
    return numbered(rows, [], order, bucket, out="id").withColumn("id", F.col("id") + F.lit(first_id - 1))


def append_history(rows: DataFrame, path: str, order: list[str], bucket) -> None:
    """Append rows to a history table; ids go on after the largest one stored."""
    spark = rows.sparkSession
    try:
        last = spark.read.parquet(path).agg(F.max("id")).first()[0] or 0
    except AnalysisException:  # the table does not exist yet
        last = 0
    with_history_ids(rows, order, bucket, last + 1).write.mode("append").parquet(path)
