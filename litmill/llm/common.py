"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmill.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A given table, only the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many "_" in front as it takes for ``df`` to lack them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def release() -> None:
    """Gives Arrow's unused memory back: a Python worker stays alive for later tasks of other kinds."""
    pa.default_memory_pool().release_unused()


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as empty text."""
    key = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % n


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Adds the sum of all earlier rows' values, per ``keys`` (none: over everything) along ``order``.

    ``values``: value column by new column. Rows are dealt by sampled ranges of (keys, order), so a key of any size is
    spread over tasks; each range is summed by itself and gets the total of the key's earlier ranges. The rows that are
    summed in one place are one per (range, key). Ranges are written once, so a lost task can't change them.
    """
    n = tasks(df.sparkSession)
    dealt = df.repartitionByRange(n, *[F.col(c) for c in (*keys, *order)]).withColumn("_range", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    part = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_k{i}") for i, k in enumerate(keys)]
    null = [F.col(k).isNull().alias(f"_n{i}") for i, k in enumerate(keys)]
    named = [f"_{x}{i}" for x in "kn" for i in range(len(keys))]
    totals = dealt.groupBy("_range", *part, *null).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    before = Window.partitionBy(*named).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *named, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values])
    inside = Window.partitionBy("_range", *named).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.select("*", *part, *null).join(offsets, ["_range", *named])
    out = {n: F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"_o_{n}") for n, v in values.items()}
    return rows.withColumns(out).drop("_range", *named, *[f"_o_{n}" for n in values])
