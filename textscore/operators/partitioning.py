"""Explicit hash clustering of rows before CPU-heavy row expansion."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partition_count(df: DataFrame, num_partitions: int | None = None) -> int:
    """The session's shuffle partition count (at least the default parallelism)."""
    if num_partitions:
        return num_partitions
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)


def cluster_rows(df: DataFrame, *cols: str, num_partitions: int | None = None) -> DataFrame:
    """Hash-partition rows on ``cols`` with an explicit partition count.

    The count is explicit on purpose: AQE would coalesce this exchange by the
    bytes of its input (raw text), but every row is expanded 10-20x into token
    and n-gram rows right after it, so input bytes badly under-state the work.
    Later groupings whose keys include ``cols`` reuse this partitioning.
    """
    return df.repartition(partition_count(df, num_partitions), *cols)


def partitions_by_text(df: DataFrame, text_col: str, per_partition: int = 1_000_000) -> int:
    """Partitions of about ``per_partition`` characters each, so that what a task holds
    does not grow with the table; at least ``partition_count``.  Reads the column once."""
    chars = df.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0]
    return max(partition_count(df), math.ceil(chars / per_partition))
