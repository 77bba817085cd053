"""Streaming evaluation (ST1).

Predictions arrive as files.  Each micro-batch is scored into BLEU / exact
match *partial states* (the mergeable counters of A13) and written under
``mb=<batch id>`` with overwrite, so a replayed micro-batch replaces its own
output instead of adding to it.  The current score at any time is the sum of
all partial states run through the BLEU formula; it equals the batch result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textscore.operators.bleu import bleu_components, bleu_finalize, merge_components
from textscore.operators.metrics import exact_match_flag
from textscore.operators.rows import merge_single_rows


def _score_batch(batch: DataFrame, group_cols, tokenizer, max_order) -> DataFrame:
    comp = bleu_components(batch, group_cols=group_cols, tokenizer=tokenizer, max_order=max_order)
    em = batch.groupBy(*group_cols).agg(
        F.sum(exact_match_flag("pred", "ref")).cast("long").alias("em_hits"), F.count(F.lit(1)).alias("em_rows")
    )
    if group_cols:
        return comp.join(em, list(group_cols), "full")
    return _attach(comp, em)


def _attach(comp: DataFrame, em: DataFrame) -> DataFrame:
    # both sides are global aggregates (one row each): put them side by side
    return merge_single_rows(comp, em)


def _state_log(spark: SparkSession, state_path: str) -> tuple[dict[int, str], dict[int, str]]:
    """Committed micro-batch states and folds by batch id."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(state_path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, dict[int, str]] = {"mb": {}, "upto": {}}
    if fs.exists(root):
        for entry in fs.listStatus(root):
            kind, _, number = entry.getPath().getName().partition("=")
            if kind in found and fs.exists(jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
                found[kind][int(number)] = entry.getPath().toString()
    return found["mb"], found["upto"]


def _delete(spark: SparkSession, paths: Sequence[str]) -> None:
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_states(spark: SparkSession, state_path: str, upto: int | None = None) -> DataFrame:
    """The last complete fold and the states after it (those up to ``upto`` only)."""
    states, folds = _state_log(spark, state_path)
    last = max((k for k in folds if upto is None or k <= upto), default=-1)
    paths = [folds[last]] if last >= 0 else []
    paths += [p for k, p in sorted(states.items()) if k > last and (upto is None or k <= upto)]
    if not paths:
        raise FileNotFoundError(f"no micro-batch state under {state_path}")
    return spark.read.parquet(*paths)


def compact(spark: SparkSession, state_path: str, upto: int, group_cols: Sequence[str] = (), max_order: int = 4) -> None:
    """Fold all states up to micro-batch ``upto`` into one.

    Replay-safe: a fold that a failure cut short is written anew from the same states;
    a state that a fold holds is never written or counted again.  ``upto`` must be a
    micro-batch that the stream has committed.
    """
    states, folds = _state_log(spark, state_path)
    if upto in folds or not any(k <= upto for k in states):
        return
    earlier = max((k for k in folds if k < upto), default=-1)
    merged = _merged(read_states(spark, state_path, upto), list(group_cols), max_order)
    merged.write.mode("overwrite").parquet(f"{state_path.rstrip('/')}/upto={upto}")
    # what the fold before this one had replaced already
    _delete(spark, [p for k, p in states.items() if k <= earlier] + [p for k, p in folds.items() if k < earlier])


def _merged(states: DataFrame, group_cols: list[str], max_order: int) -> DataFrame:
    comp = merge_components(states, group_cols, max_order)
    em = states.groupBy(*group_cols).agg(F.sum("em_hits").alias("em_hits"), F.sum("em_rows").alias("em_rows"))
    return comp.join(em, group_cols, "full") if group_cols else _attach(comp, em)


def score_micro_batch(
    batch: DataFrame,
    batch_id: int,
    state_path: str,
    group_cols: Sequence[str] = (),
    tokenizer: str = "13a",
    max_order: int = 4,
    compact_every: int = 0,
) -> None:
    """Write one micro-batch's partial state under ``mb=<batch_id>``; a replay of
    the same batch id replaces that folder, so it is never counted twice, and one
    that a fold holds is left alone."""
    spark = batch.sparkSession
    _, folds = _state_log(spark, state_path)
    if not any(batch_id <= k for k in folds):
        kept = batch.persist()  # BLEU and exact match read it; the source is read once
        try:
            _score_batch(kept, list(group_cols), tokenizer, max_order).write.mode("overwrite").parquet(f"{state_path.rstrip('/')}/mb={batch_id}")
        finally:
            kept.unpersist()
    if compact_every and batch_id and batch_id % compact_every == 0:
        # a running micro-batch says that all before it are committed
        compact(spark, state_path, batch_id - 1, group_cols, max_order)


def start_stream(
    spark: SparkSession,
    source_path: str,
    state_path: str,
    checkpoint_path: str,
    schema: str = "id long, pred string, ref string",
    group_cols: Sequence[str] = (),
    tokenizer: str = "13a",
    max_order: int = 4,
    fmt: str = "parquet",
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
    compact_every: int = 100,
):
    """Start the query; returns the ``StreamingQuery``.  The state log is folded every
    ``compact_every`` micro-batches (never with 0)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source_path)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        score_micro_batch(batch, batch_id, state_path, group_cols, tokenizer, max_order, compact_every)

    writer = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def current_scores(
    spark: SparkSession,
    state_path: str,
    group_cols: Sequence[str] = (),
    max_order: int = 4,
    smooth: bool = False,
) -> DataFrame:
    """Merge the last fold and the states after it, and finish the metrics."""
    states = read_states(spark, state_path)
    comp = merge_components(states, group_cols, max_order)
    em = states.groupBy(*group_cols).agg(
        (F.sum("em_hits") / F.sum("em_rows")).alias("exact_match"), F.sum("em_rows").cast("long").alias("em_rows")
    )
    scores = bleu_finalize(comp, group_cols, max_order=max_order, smooth=smooth)
    if group_cols:
        return scores.join(em, list(group_cols), "left")
    return _attach(scores, em)
