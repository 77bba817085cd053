"""Data assertions on record order (W1, W2): sorted by date, no time leak."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textscore.operators.ordering import order_violations

# Fixed value: the reference's date layout %Y-%m-%dT%H:%M:%SZ.  Single-letter
# fields also accept unpadded values such as 2024-1-1T0:0:0Z, as strptime does.
DATE_PATTERN = "y-M-d'T'H:m:s'Z'"


def parse_date(c: Column, pattern: str = DATE_PATTERN) -> Column:
    """Parse once into a zone-less timestamp (the reference compares naive
    datetimes); an unparsable value fails the job (ANSI)."""
    return F.to_timestamp_ntz(c, F.lit(pattern))


def _as_ts(df: DataFrame, date_col: str, pattern: str) -> Column:
    if isinstance(df.schema[date_col].dataType, T.StringType):
        return parse_date(F.col(date_col), pattern)
    return F.col(date_col)


def sorted_by_date(
    df: DataFrame,
    pos_col: str,
    date_col: str = "date",
    partition_cols: Sequence[str] = (),
    pattern: str = DATE_PATTERN,
) -> DataFrame:
    """Is each partition non-decreasing by date in position order?

    Equal dates are fine; 0 or 1 rows count as sorted.  Output: partition
    columns, ``sorted``, ``rows``, ``violations``, ``first_violation_pos``,
    ``first_date``, ``last_date``.
    """
    x = df.select(*partition_cols, pos_col, _as_ts(df, date_col, pattern).alias("_ts"))
    v = order_violations(x, pos_col, "_ts", partition_cols)
    return v.select(
        *partition_cols,
        (F.col("violations") == 0).alias("sorted"),
        "rows",
        "violations",
        "first_violation_pos",
        F.col("first_value").alias("first_date"),
        F.col("last_value").alias("last_date"),
    )


def leak_check(
    df: DataFrame,
    pos_col: str,
    date_col: str = "date",
    split_col: str = "split",
    train: str = "train",
    test: str = "test",
    pattern: str = DATE_PATTERN,
) -> DataFrame:
    """Train sorted, test sorted, and train's last date <= test's first date.

    One output row: ``ok``, ``reason`` (first failing check in that order:
    ``train_unsorted``, ``test_unsorted``, ``leak``; else ``ok``), the violation
    counts and the two boundary dates.  An empty split and a null date fail the job:
    a check that does not know a date must not pass.
    """
    x = df.where(F.col(split_col).isin(train, test))
    unknown = F.raise_error(F.lit("leak check: null date")).cast(df.schema[date_col].dataType)
    x = x.withColumn(date_col, F.when(F.col(date_col).isNull(), unknown).otherwise(F.col(date_col)))
    per = sorted_by_date(x, pos_col, date_col, [split_col], pattern)

    def pick(col: str, split: str) -> Column:
        return F.max(F.when(F.col(split_col) == split, F.col(col)))

    one = per.agg(
        pick("violations", train).alias("train_violations"),
        pick("violations", test).alias("test_violations"),
        pick("last_date", train).alias("train_last_date"),
        pick("first_date", test).alias("test_first_date"),
    )
    empty = F.col("train_violations").isNull() | F.col("test_violations").isNull()
    reason = (
        F.when(empty, F.raise_error(F.lit("leak check: empty train or test split")))
        .when(F.col("train_violations") > 0, F.lit("train_unsorted"))
        .when(F.col("test_violations") > 0, F.lit("test_unsorted"))
        .when(F.col("train_last_date") > F.col("test_first_date"), F.lit("leak"))
        .otherwise(F.lit("ok"))
    )
    return one.select(
        (reason == "ok").alias("ok"),
        reason.alias("reason"),
        "train_violations",
        "test_violations",
        "train_last_date",
        "test_first_date",
    )
