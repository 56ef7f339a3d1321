"""Ordered work on keys of any size.

A window over a key that holds a third of all rows runs in one task. Here the order column is cut
into buckets (an hour, a thousand turns): rows are numbered or summed inside (key, bucket), the small
table of bucket totals gives each bucket its offset, and the two are joined. Results equal those of
the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TASK_ROWS = 1_000_000


def _offsets(df: DataFrame, keys: Sequence[str], total: Column) -> DataFrame:
    """Total of all earlier buckets of the same key, one row per (key, bucket)."""
    totals = df.groupBy(*keys, "_bucket").agg(total.alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"),
    )


def _joined(df: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(offsets, cond, "left").drop("_b", *[f"_k{i}" for i in range(len(keys))])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str = "row_no") -> DataFrame:
    """1, 2, 3, ... per key in ``order``; ``bucket`` must not decrease along the order."""
    b = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    rows = _joined(b, _offsets(b, keys, F.count("*")), keys)
    return rows.withColumn(out, F.row_number().over(inside) + F.col("_offset")).drop("_bucket", "_offset")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, bucket: Column, out: str
) -> DataFrame:
    """Sum of ``value`` from the first row of a key up to this row."""
    b = df.withColumn("_bucket", bucket).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = _joined(b, _offsets(b, keys, F.sum("_value")), keys)
    return rows.withColumn(out, F.sum("_value").over(inside) + F.col("_offset")).drop("_bucket", "_offset", "_value")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row per key by ``order`` (ascending), as an aggregate: copies are reduced before the shuffle."""
    rank = F.struct(*order)
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row")) if rest else df.groupBy(*keys).agg()
    return agg.select(*keys, "_row.*").select(*df.columns)


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row per key by ``order``, reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return agg.select(*keys, "_row.*").select(*df.columns)


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group (all without ``k``) with their rank; Spark limits each partition before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    out = df.withColumn(rank, F.row_number().over(w))
    return out if k is None else out.where(F.col(rank) <= k)


def spread(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``df`` dealt by its keys to tasks of about TASK_ROWS rows each: ``rows`` is its number of rows, or what a task makes of them."""
    return df.repartition(max(-(-rows // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism), *keys)


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], bucket: Column) -> DataFrame:
    """Several running sums in one pass; see ``running_sum``."""
    b = df.withColumn("_bucket", bucket).withColumns({f"_v_{n}": v for n, v in values.items()})
    totals = b.groupBy(*keys, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_bucket").alias("_b"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values],
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = _joined(b, offsets, keys)
    rows = rows.withColumns({n: F.sum(f"_v_{n}").over(inside) + F.col(f"_o_{n}") for n in values})
    return rows.drop("_bucket", *[f"_v_{n}" for n in values], *[f"_o_{n}" for n in values])


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, bucket: Column, out: str) -> DataFrame:
    """``value`` of the row before, per key; the last row of the nearest earlier bucket stands before a bucket."""
    b = df.withColumn("_bucket", bucket)
    ends = b.groupBy(*keys, "_bucket").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_end"))
    w = Window.partitionBy(*keys).orderBy("_bucket")
    before = ends.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), F.lag("_end").over(w).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    rows = _joined(b, before, keys)
    first = F.row_number().over(inside) == 1
    return rows.withColumn(out, F.when(first, F.col("_offset")["v"]).otherwise(F.lag(value).over(inside))).drop("_bucket", "_offset")
