"""Numbering and prefix scans in which one key may hold most of the rows.

A window over a key runs in one task, however many rows the key has.  Here the
rows of a key are cut into ranges: a window runs within each ``(key, range)``,
every range is reduced to one mergeable summary row, the summaries are scanned in
range order, and what the earlier ranges come to is joined back on
``(key, range)``, by which the window has dealt the rows out already.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textscore.session import scratch_path

RANGE = 4096  # rows or steps in one range


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back: later steps
    read one result, and a lost executor costs only the lost tasks."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> tuple[DataFrame, Column]:
    """``right`` with its keys renamed, and the null-safe condition on equal keys."""
    renamed = right.withColumnsRenamed({c: f"{prefix}{i}" for i, c in enumerate(keys)})
    on = F.lit(True)
    for i, c in enumerate(keys):
        on = on & left[c].eqNullSafe(renamed[f"{prefix}{i}"])
    return renamed, on


def number_rows(df: DataFrame, order_cols: Sequence[str], partition_cols: Sequence[str] = (), out_col: str = "rn") -> DataFrame:
    """``df`` plus ``row_number() over (partition by P order by O)``, from 1, as a long.

    A range partitioner orders the rows by P and O, whatever their types, so a
    partition value with most of the rows, or strings that share a prefix, spread
    over many tasks (rows with equal P and O stay together).  The sorted rows are
    stored with their place in their task; how many rows of the same P stand in
    earlier tasks is one number for each task whose first P began earlier.  Nulls
    come first and are numbered like other values; rows equal in P and O are
    numbered in an order that the stored rows fix.
    """
    pcols, ocols = list(partition_cols), list(order_cols)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = df.repartitionByRange(tasks, *pcols, *ocols).sortWithinPartitions(*pcols, *ocols)
    # the task's number in the upper bits, the row's place in the task in the lower 33
    x = stored(ranged.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    x = x.withColumn("_task", F.shiftright("_place", 33))
    counts = x.groupBy(*pcols, "_task").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*pcols).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.sum("_rows").over(earlier)).where("_off is not null").drop("_rows")
    if pcols:
        local = x.withColumn("_rn", F.row_number().over(Window.partitionBy(*pcols, "_task").orderBy("_place")))
    else:
        local = x.withColumn("_rn", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    renamed, on = same_keys(local, offsets, [*pcols, "_task"], "_o")
    joined = local.join(renamed, on, "left")
    return joined.select(*df.columns, (F.col("_rn") + F.coalesce("_off", F.lit(0))).cast("long").alias(out_col))


def range_of(df: DataFrame, col: str, width: int | None = None) -> Column:
    """The range of an order column: ``width`` neighbouring values of an integer column.
    Other types have no fixed ranges and stay in one (``number_rows`` ranges them)."""
    width = width or RANGE
    if isinstance(df.schema[col].dataType, T.IntegralType):
        return F.expr(f"cast(`{col}` as bigint) div {width}")
    return F.lit(0).cast("long")


def _merge(how: str, first: Column, then: Column) -> Column:
    return F.greatest(first, then) if how == "max" else F.coalesce(first + then, first, then)


def with_carry(
    df: DataFrame,
    keys: Sequence[str],
    range_cols: Sequence[str],
    carry: Mapping[str, tuple[str, Column]],
    coarse: Column | None = None,
    only: Column | None = None,
) -> DataFrame:
    """``df`` plus, for every row, what the earlier ranges of its key come to.

    ``carry`` names what is carried: ``("sum" | "max", column)``, null where no earlier
    range has a value.  ``coarse`` is a column over ``range_cols`` that never decreases
    along them; with it the summaries of a key are scanned in two levels, so that even
    their number does not meet in one task.  ``only`` restricts what is summarised, where
    other rows are known to be followed by no range of their key.
    """
    keys, ranges, how = list(keys), list(range_cols), {n: kind for n, (kind, _) in carry.items()}
    fold = {"sum": F.sum, "max": F.max}
    rows = df if only is None else df.where(only)
    parts = rows.groupBy(*keys, *ranges).agg(*(fold[kind](c).alias(n) for n, (kind, c) in carry.items()))
    parts = parts.withColumn("_big", F.lit(0).cast("long") if coarse is None else coarse)
    earlier = Window.partitionBy(*keys, "_big").orderBy(*ranges).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*keys, *ranges, "_big", *(fold[how[n]](n).over(earlier).alias(n) for n in carry))
    if coarse is not None:
        before = Window.partitionBy(*keys).orderBy("_big").rowsBetween(Window.unboundedPreceding, -1)
        tops = parts.groupBy(*keys, "_big").agg(*(fold[how[n]](n).alias(n) for n in carry))
        tops = tops.select(*keys, "_big", *(fold[how[n]](n).over(before).alias(f"_t_{n}") for n in carry))
        renamed, on = same_keys(carried, tops, [*keys, "_big"], "_b")
        carried = carried.join(renamed, on).withColumns({n: _merge(how[n], F.col(f"_t_{n}"), F.col(n)) for n in carry})
    some = F.coalesce(*(F.when(F.col(n).isNotNull(), True) for n in carry))
    renamed, on = same_keys(df, carried.where(some).select(*keys, *ranges, *carry), [*keys, *ranges], "_c")
    return df.join(renamed, on, "left").select(*df.columns, *carry)


def running_sums(
    df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], range_cols: Sequence[str], sums: Mapping[str, Column | str],
    coarse: Column | None = None, only: Column | None = None,
) -> DataFrame:
    """``df`` plus running sums (the row's own value included) within each key.

    ``range_cols`` cut a key into ranges and never decrease along ``order_cols``;
    ``coarse`` and ``only`` are those of ``with_carry``.
    """
    w = Window.partitionBy(*keys, *range_cols).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    cols = {n: F.col(c) if isinstance(c, str) else c for n, c in sums.items()}
    x = with_carry(df, keys, range_cols, {f"_b_{n}": ("sum", c) for n, c in cols.items()}, coarse, only)
    totals = {n: _merge("sum", F.col(f"_b_{n}"), F.sum(c).over(w)) for n, c in cols.items()}
    return x.withColumns(totals).select(*df.columns, *cols)
