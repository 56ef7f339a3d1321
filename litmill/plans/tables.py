"""Readers for the registered queries: one parquet file per table, columns pruned by the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """For heavy work per row: dealt to ``litmill.input.partitions`` tasks where the session sets that number.

    A local session sets it, as its tables are single files of one row group. A cluster leaves it unset: the
    splits of large tables are many, and nothing is shuffled.
    """
    parts = df.sparkSession.conf.get("litmill.input.partitions", None)
    return df if parts is None else df.repartition(int(parts))
