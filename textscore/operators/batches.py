"""Seeded shuffle, batch assignment and epoch plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textscore.operators.ordering import md5_bucket, md5_digits_for, row_number_by


def shuffle_key(id_col: str, seed: int):
    """Deterministic shuffle order: md5 of ``'<seed>:<id>'`` (same in any engine)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def assign_batches(
    df: DataFrame,
    id_col: str,
    batch_size: int,
    shuffle: bool = True,
    seed: int = 42,
    partition_cols: Sequence[str] = (),
) -> DataFrame:
    """``position`` (1-based, shuffled or by id) and ``batch_id`` = (position-1) div size.

    The last batch may be partial.  The numbering runs in md5 prefix buckets when
    shuffled, in the tasks of a range partitioner otherwise (ids of any type), never in
    a global window in one task.
    """
    if shuffle:
        x = df.withColumn("_order", shuffle_key(id_col, seed))
        bucket = md5_bucket(F.col("_order"), md5_digits_for(df))
        numbered = row_number_by(x, ["_order"], partition_cols, bucket=bucket, out_col="position")
        numbered = numbered.drop("_order")
    else:
        numbered = row_number_by(df, [id_col], partition_cols, out_col="position")
    return numbered.withColumn("batch_id", F.floor((F.col("position") - 1) / F.lit(batch_size)).cast("long"))


def epoch_plan(
    df: DataFrame,
    batch_size: int,
    epochs: int,
    split_col: str | None = "split",
) -> DataFrame:
    """Rows, batches per epoch (= steps per epoch), total steps and the
    nominal example count (batches x size, which over-counts a partial batch)."""
    keys = [split_col] if split_col else []
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    batches = F.ceil(F.col("rows") / F.lit(batch_size)).cast("long")
    return counts.select(
        *keys,
        "rows",
        batches.alias("steps_per_epoch"),
        (batches * F.lit(epochs)).alias("total_steps"),
        (batches * F.lit(batch_size)).alias("nominal_examples"),
    )
