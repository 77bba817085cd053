"""Combining single-row results without a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_single_rows(*frames: DataFrame) -> DataFrame:
    """Put the columns of several one-row results (global aggregates) side by
    side: union them by name, then take each column's non-null value.  No join,
    and the union holds one row per input frame."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    cols = []
    for f in frames:
        cols.extend(c for c in f.columns if c not in cols)
    return out.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])
