"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textscore.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the cluster's shared folder and read it back.

    Cuts the lineage, so a lost executor costs only the lost tasks, and lets
    several later steps read one result.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(id_col: Column | str, m: int) -> Column:
    """crc32 of the id written as text, modulo ``m`` (null for a null id)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % m


def hash_unit(*cols: Column | str) -> Column:
    """A number in [0, 1) fixed by the columns' values."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """Apply a batch function inside the tasks; ``make`` runs once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            out = step(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def with_batch_columns(
    df: DataFrame, inputs: list[str], make: Callable[[], Callable[..., list]], columns: dict[str, tuple[str, pa.DataType]], drop: tuple[str, ...] = ()
) -> DataFrame:
    """``df`` plus columns computed from ``inputs`` batch by batch.

    ``make()`` runs once per task and returns a function from one Python list per
    input column to one sequence per new column.  ``columns`` maps each new name
    to its SQL and Arrow type; a column of ``df`` with a new column's name is
    replaced; columns of ``drop`` are not handed back (a text that has been read).
    """
    kept = [c for c in df.columns if c not in columns and c not in drop]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in kept]
    schema = ", ".join(fields + [f"`{n}` {sql}" for n, (sql, _) in columns.items()])
    kinds = [t for _, t in columns.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            got = step(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs])
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            arrays += [pa.array(v, t) for v, t in zip(got, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=kept + list(columns))

    return df.mapInArrow(run, schema)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
