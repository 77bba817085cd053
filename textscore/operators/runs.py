"""Training-run analytics over step and epoch logs.

Step log: ``(run, epoch, step, loss)``; epoch log: ``(run, epoch, bleu, em)``.
One run, or one epoch of it, may hold most of the rows: every running figure is a
prefix scan over ranges of ``RANGE`` steps or epochs (see ``scan``), whose summaries
(counts, sums, maxima, the last improvement) are merged in order and joined back by
range.  No window covers more than one range of rows; what a window over a run sees
is one row for each of its ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textscore.operators.scan import RANGE, range_of, running_sums, same_keys, with_carry


def _round(c, decimals: int, half_even: bool) -> Column:
    """Half-up by default; ``half_even`` rounds exact ties to even as Python's
    ``round`` does on exactly representable values."""
    return F.bround(c, decimals) if half_even else F.round(c, decimals)


def _mean(steps: DataFrame, col: str, total: Column, n: Column) -> Column:
    """``total / n``; a decimal keeps 12 more digits, so a later rounding is of the exact mean."""
    dt = steps.schema[col].dataType
    if isinstance(dt, T.DecimalType):
        return total.cast(T.DecimalType(26, dt.scale)) / n.cast("decimal(12,0)")
    return total / n


def global_steps(steps: DataFrame, run_col: str = "run", epoch_col: str = "epoch", step_col: str = "step", out_col: str = "global_step") -> DataFrame:
    """1-based step number across epochs, per run.

    Steps are numbered within ranges of an epoch; the counts of earlier ranges and
    epochs are summed in two levels (epochs, and ranges of epochs).  Steps that repeat
    within an epoch share a range and are numbered in any order.
    """
    x = steps.withColumn("_rng", range_of(steps, step_col))
    x = with_carry(x, [run_col], [epoch_col, "_rng"], {"_off": ("sum", F.lit(1).cast("long"))}, coarse=range_of(steps, epoch_col))
    own = F.row_number().over(Window.partitionBy(run_col, epoch_col, "_rng").orderBy(step_col))
    return x.withColumn(out_col, (own + F.coalesce("_off", F.lit(0))).cast("long")).select(*steps.columns, out_col)


def epoch_mean_loss(
    steps: DataFrame, run_col: str = "run", epoch_col: str = "epoch", loss_col: str = "loss", decimals: int = 5, half_even: bool = False
) -> DataFrame:
    """A10: mean training loss per epoch, rounded."""
    return steps.groupBy(run_col, epoch_col).agg(
        _round(F.avg(loss_col), decimals, half_even).alias("train_loss"), F.count(F.lit(1)).alias("steps")
    )


def running_loss(
    steps: DataFrame,
    run_col: str = "run",
    epoch_col: str = "epoch",
    step_col: str = "step",
    loss_col: str = "loss",
    decimals: int = 5,
    half_even: bool = False,
) -> DataFrame:
    """Running mean loss inside an epoch, null losses left out.

    Running sums and counts over ranges of steps; a range takes the sum and count of
    the earlier ranges of its epoch from their summaries.
    """
    x = steps.withColumn("_rng", range_of(steps, step_col))
    x = running_sums(x, [run_col, epoch_col], [step_col], ["_rng"], {"_sum": loss_col, "_n": F.col(loss_col).isNotNull().cast("long")})
    mean = F.when(F.col("_n") > 0, _mean(steps, loss_col, F.col("_sum"), F.col("_n")))
    return x.withColumn("avg_loss", _round(mean, decimals, half_even)).select(*steps.columns, "avg_loss")


def interval_perplexity(
    steps: DataFrame,
    logging_steps: int,
    run_col: str = "run",
    global_step_col: str = "global_step",
    loss_col: str = "loss",
    decimals: int = 4,
    half_even: bool = False,
) -> DataFrame:
    """exp(mean loss since the last logging boundary).

    A boundary step still belongs to the interval it closes; intervals span
    epochs; ``logging_steps <= 0`` means one interval for the whole run.

    A segmented scan: running sums over ranges of steps start anew at a boundary, and
    a range takes over the sums of the interval that reaches into it.  Only intervals
    that reach over the end of a range are summarised.
    """
    g = F.col(global_step_col).cast("long") - 1
    interval = F.floor(g / F.lit(logging_steps)).cast("long") if logging_steps > 0 else F.lit(0).cast("long")
    x = steps.withColumn("_iv", interval).withColumn("_rng", F.floor(g / F.lit(RANGE)).cast("long"))
    crosses = None
    if logging_steps > 0:
        first, last = F.col("_iv") * logging_steps, (F.col("_iv") + 1) * logging_steps - 1
        crosses = F.floor(first / F.lit(RANGE)) != F.floor(last / F.lit(RANGE))
    sums = {"_sum": loss_col, "_n": F.col(loss_col).isNotNull().cast("long")}
    x = running_sums(x, [run_col, "_iv"], [global_step_col], ["_rng"], sums, only=crosses)
    mean = F.when(F.col("_n") > 0, _mean(steps, loss_col, F.col("_sum"), F.col("_n")))
    return x.withColumn("perplexity", _round(F.exp(mean), decimals, half_even)).select(*steps.columns, "perplexity")


def epoch_progress(
    epochs: DataFrame,
    max_patience: int = -1,
    run_col: str = "run",
    epoch_col: str = "epoch",
    bleu_col: str = "bleu",
    em_col: str = "em",
    milestone_index: int = 9,
) -> DataFrame:
    """W5 + W6: best-so-far flags, patience and the early-stop epoch.

    Per epoch: the BLEU check resets patience on a strict improvement (also
    over 0) else adds 1, then the exact-match check does the same; stop at the
    first epoch whose patience *equals* ``max_patience`` (-1 never stops).
    Patience has a closed form: with ``r`` the last epoch up to now where either
    metric improved, it is ``(0 if EM improved at r else 1) + 2 * (t - r)``, and
    ``2 * (epochs so far)`` before any improvement.

    A mergeable prefix scan over ranges of epochs.  The summary of a range is its
    epochs, and each metric's maximum with the first place that has it: the range's
    last improvement, if it beats what earlier ranges reached.  Merged in order, the
    summaries give each range the epochs before it, the maxima so far and the last
    improvement; the rest is decided within the range.
    """
    places = [run_col, "_rng"]
    w = Window.partitionBy(*places).orderBy(epoch_col)
    prior, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    x = epochs.withColumn("_rng", range_of(epochs, epoch_col)).withColumn("_i", F.row_number().over(w).cast("long"))
    metrics = {"b": bleu_col, "e": em_col}
    first_best = {k: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), (-F.col("_i")).alias("i")))) for k, c in metrics.items()}
    s = x.groupBy(*places).agg(F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in first_best.items()))
    before = Window.partitionBy(run_col).orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    for k in metrics:
        s = s.withColumn(f"_c{k}", F.greatest(F.lit(0.0), F.max(f"{k}.v").over(before)))
        s = s.withColumn(f"_at_{k}", F.when(F.col(f"{k}.v") > F.col(f"_c{k}"), F.col("_off") - F.col(f"{k}.i")))
    at = F.greatest("_at_b", "_at_e")
    reset = F.when(at.isNotNull(), F.struct(at.alias("idx"), F.coalesce(F.col("_at_e") == at, F.lit(False)).alias("em")))
    s = s.withColumn("_last", F.last(reset, ignorenulls=True).over(before)).select(*places, "_off", "_cb", "_ce", "_last")
    renamed, on = same_keys(x, s, places, "_k")
    x = x.join(renamed, on).withColumn("_idx", F.col("_i") + F.col("_off"))
    for k, (name, c) in {"b": ("best_bleu", bleu_col), "e": ("best_em", em_col)}.items():
        x = x.withColumn(name, F.col(c) > F.greatest(F.col(f"_c{k}"), F.max(c).over(prior)))
    here = F.when(F.col("best_bleu") | F.col("best_em"), F.struct(F.col("_idx").alias("idx"), F.coalesce("best_em", F.lit(False)).alias("em")))
    x = x.withColumn("_last", F.coalesce(F.last(here, ignorenulls=True).over(upto), F.col("_last")))
    patience = F.when(F.col("_last").isNull(), 2 * F.col("_idx")).otherwise(
        F.when(F.col("_last.em"), F.lit(0)).otherwise(F.lit(1)) + 2 * (F.col("_idx") - F.col("_last.idx"))
    )
    x = x.withColumn("patience", patience.cast("int"))
    x = x.withColumn("milestone", (F.col("_idx") - 1) == F.lit(milestone_index))
    kind = epochs.schema[epoch_col].dataType
    if max_patience >= 0:
        # the first hit of a run, put beside each of its ranges
        hits = x.groupBy(*places).agg(F.min(F.when(F.col("patience") == max_patience, F.col(epoch_col))).alias("_hit"))
        hits = hits.select(*places, F.min("_hit").over(Window.partitionBy(run_col)).alias("stop_epoch"))
        renamed, on = same_keys(x, hits, places, "_h")
        x = x.join(renamed, on)
    else:
        x = x.withColumn("stop_epoch", F.lit(None).cast(kind))
    x = x.withColumn("stopped_here", F.coalesce(F.col(epoch_col) == F.col("stop_epoch"), F.lit(False)))
    return x.select(*epochs.columns, "best_bleu", "best_em", "patience", "milestone", "stop_epoch", "stopped_here")


def best_epochs(progress: DataFrame, run_col: str = "run", epoch_col: str = "epoch") -> DataFrame:
    """Best BLEU / EM epoch per run, up to the stop epoch.

    The best epoch is the last strict improvement (= first epoch reaching the
    maximum).  If BLEU never improved and the run stopped, the stop epoch
    stands in for BLEU.
    """
    live = progress.where(F.col("stop_epoch").isNull() | (F.col(epoch_col) <= F.col("stop_epoch")))
    agg = live.groupBy(run_col).agg(
        F.max(F.when(F.col("best_bleu"), F.col(epoch_col))).alias("_bb"),
        F.max(F.when(F.col("best_em"), F.col(epoch_col))).alias("best_em_epoch"),
        F.max("stop_epoch").alias("stop_epoch"),
        F.max(F.col(epoch_col)).alias("last_epoch"),
    )
    return agg.select(
        run_col,
        F.coalesce("_bb", "stop_epoch").alias("best_bleu_epoch"),
        "best_em_epoch",
        "stop_epoch",
        "last_epoch",
    )


def rank_runs(scores: DataFrame, run_col: str = "run", by: str = "bleu_score", then: str | None = "exact_match") -> DataFrame:
    """Rank runs by BLEU (then exact match); one row per run, so the
    unpartitioned window covers only as many rows as there are runs."""
    order = [F.desc(by)] + ([F.desc(then)] if then else []) + [F.asc(run_col)]
    return scores.withColumn("rank", F.rank().over(Window.orderBy(*order)).cast("int"))
