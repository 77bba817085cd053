"""Global order without a global window (row numbers, neighbour checks).

``Window.orderBy`` without ``partitionBy`` (or with a low-cardinality partition
such as 20 runs) sends every row of a partition to one task.  Here rows are dealt
out in order, by a range partitioner (any type; no statistics on the driver while
planning) or into given buckets; a window runs within what one task got, each task's
share is reduced to one summary row, and the few summary rows are ordered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textscore.operators.scan import number_rows


def epoch_micros(c: Column, dt: T.DataType) -> Column:
    """Microseconds since 1970-01-01 00:00:00; for TIMESTAMP_NTZ independent of
    the session time zone (no cast through a zone)."""
    if isinstance(dt, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    return F.unix_micros(c)


def _default_buckets(df: DataFrame) -> int:
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def md5_bucket(key: Column, hex_digits: int = 3) -> Column:
    """Bucket of an md5 hex order key: its first hex digits (4,096 buckets for 3)."""
    return F.conv(F.substring(key, 1, hex_digits), 16, 10).cast("long")


def md5_digits_for(df: DataFrame, min_digits: int = 3) -> int:
    """Hex digits so that md5-prefix buckets number at least four per shuffle
    partition (3 digits = 4,096 buckets locally, 5 = ~1M on a large cluster)."""
    return max(min_digits, math.ceil(math.log(max(2, _default_buckets(df)), 16)))


def row_number_by(
    df: DataFrame,
    order_cols: Sequence[str],
    partition_cols: Sequence[str] = (),
    bucket: Column | None = None,
    out_col: str = "rn",
) -> DataFrame:
    """``row_number() over (partition by P order by O)`` without a window over P.

    Without ``bucket`` a range partitioner puts the rows in order (``number_rows``).
    A ``bucket`` must be non-decreasing in the order key within a partition; the
    numbering then runs bucket by bucket.  The order key should be unique within a
    partition, as for any deterministic numbering.
    """
    pcols = list(partition_cols)
    ocols = list(order_cols)
    if bucket is None:
        return number_rows(df, ocols, pcols, out_col)
    x = df.withColumn("_bkt", bucket)
    w = Window.partitionBy(*pcols, "_bkt").orderBy(*ocols)
    numbered = x.withColumn("_rb", F.row_number().over(w))
    counts = x.groupBy(*pcols, "_bkt").agg(F.count(F.lit(1)).alias("_nb"))
    before = Window.partitionBy(*pcols).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*pcols, "_bkt", F.coalesce(F.sum("_nb").over(before), F.lit(0)).alias("_off"))
    # null-safe: null partition values and null order keys are numbered too
    keys = [*pcols, "_bkt"]
    renamed = offsets.select(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(keys)), "_off")
    same = [numbered[c].eqNullSafe(renamed[f"_o{i}"]) for i, c in enumerate(keys)]
    joined = numbered.join(renamed, same, "inner")
    drop = ["_bkt", "_rb", "_off", *(f"_o{i}" for i in range(len(keys)))]
    return joined.withColumn(out_col, (F.col("_rb") + F.col("_off")).cast("long")).drop(*drop)


def order_violations(
    df: DataFrame,
    pos_col: str,
    value_col: str,
    partition_cols: Sequence[str] = (),
) -> DataFrame:
    """Per partition: how often ``value`` decreases between neighbours in ``pos`` order.

    Output: partition columns, ``rows``, ``violations``, ``first_violation_pos``
    (the position of the later row of the first decreasing neighbour pair),
    ``first_value`` and ``last_value`` (by position).

    A range partitioner deals the rows out in order; neighbours are compared within
    a task, and where two tasks meet by their first and last values.
    """
    pcols = list(partition_cols)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    order = [*pcols, pos_col]
    x = df.select(*order, value_col).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    x = x.withColumn("_place", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_place", 33))
    w = Window.partitionBy(*pcols, "_task").orderBy("_place")
    inner = x.withColumn("_prev", F.lag(value_col).over(w))
    inner_v = inner.groupBy(*pcols, "_task").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(F.when(F.col("_prev") > F.col(value_col), 1)).alias("_v"),
        F.min(F.when(F.col("_prev") > F.col(value_col), F.col(pos_col))).alias("_first_v"),
        F.min_by(value_col, "_place").alias("_first_val"),
        F.max_by(value_col, "_place").alias("_last_val"),
        F.min_by(pos_col, "_place").alias("_first_pos"),
    )
    # neighbour pairs that straddle two tasks: a window over one row for each task
    wb = Window.partitionBy(*pcols).orderBy("_task")
    edges = inner_v.withColumn("_prev_last", F.lag("_last_val").over(wb))
    edges = edges.withColumn("_edge_v", F.col("_prev_last") > F.col("_first_val"))
    return edges.groupBy(*pcols).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("rows"),
        (F.coalesce(F.sum("_v"), F.lit(0)) + F.count(F.when(F.col("_edge_v"), 1))).cast("long").alias("violations"),
        F.least(
            F.min("_first_v"), F.min(F.when(F.col("_edge_v"), F.col("_first_pos")))
        ).alias("first_violation_pos"),
        F.min_by("_first_val", "_task").alias("first_value"),
        F.max_by("_last_val", "_task").alias("last_value"),
    )
