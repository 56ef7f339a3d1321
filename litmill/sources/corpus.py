"""Corpus sources: text files and tables, HTML pages, content-hash registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.functions.skew import last_rows
from litmill.functions.text import squeeze, strip, word_count


def non_empty(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.where(strip(F.coalesce(F.col(text), F.lit(""))) != "")


def read_corpus(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """Documents with text: a parquet table with a text column, or a folder of text files (one document each)."""
    if path.rstrip("/").endswith(".parquet"):
        return non_empty(spark.read.parquet(path), text)
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    files = files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias(text))
    return non_empty(files, text)


# ---- HTML ------------------------------------------------------------------------------------

_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def visible_text(html: Column) -> Column:
    """Text of an HTML document: scripts, styles, comments and tags dropped, common entities decoded."""
    c = F.coalesce(html, F.lit(""))
    for pattern in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->", r"(?s)<[^>]+>"):
        c = F.regexp_replace(c, pattern, " ")
    for code, ch in _ENTITIES:
        c = F.replace(c, F.lit(code), F.lit(ch))
    return squeeze(c)


def html_text_stats(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds the visible text, its words and its characters."""
    out = pages.withColumn("body_text", visible_text(F.col(html)))
    return out.withColumns({"word_count": word_count(F.col("body_text")), "char_count": F.length("body_text")})


# ---- content-hash registry --------------------------------------------------------------------


def content_hash(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def new_documents(docs: DataFrame, registry: DataFrame, text: str = "text") -> DataFrame:
    """Documents whose content hash is not registered as complete.

    Only hashes are shuffled against the registry; the registry holds one row per hash.
    """
    done = registry.where("analysis_complete").select("content_hash").distinct()
    return docs.withColumn("content_hash", content_hash(F.col(text))).join(done, "content_hash", "left_anti")


def registry_apply(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """State of the registry after a batch of changes.

    registry: content_hash, session_id, filename, analysis_complete.
    changes: seq, action (register, complete, drop_hash, drop_session), content_hash, session_id,
    filename, analysis_complete.
    The last registration of a hash decides its row; a later completion marks it, a later drop of
    the hash or of its session removes it. Every step is an aggregate with map-side combine.
    """
    columns = ["content_hash", "session_id", "filename", "analysis_complete"]
    registered = registry.select(*columns, F.lit(-1).cast("long").alias("seq")).unionByName(
        changes.where("action = 'register'").select(*columns, F.col("seq").cast("long"))
    )
    current = last_rows(registered, ["content_hash"], ["seq"])

    def latest(action: str, key: str, out: str) -> DataFrame:
        return changes.where(F.col("action") == action).groupBy(key).agg(F.max("seq").alias(out))

    # A completion counts when the hash is registered at that moment, so it must follow the registration.
    state = (
        current.join(latest("complete", "content_hash", "done_at"), "content_hash", "left")
        .join(latest("drop_hash", "content_hash", "hash_gone_at"), "content_hash", "left")
        .join(latest("drop_session", "session_id", "session_gone_at"), "session_id", "left")
    )
    never = F.lit(-2).cast("long")
    alive = F.col("seq") > F.greatest(F.coalesce("hash_gone_at", never), F.coalesce("session_gone_at", never))
    done = F.col("analysis_complete") | (F.coalesce("done_at", never) > F.col("seq"))
    return state.where(alive).select(
        "content_hash", "session_id", "filename", done.alias("analysis_complete")
    )
