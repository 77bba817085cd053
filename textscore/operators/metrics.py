"""Row metrics other than BLEU: exact match (A8), masked cross-entropy (A9),
argmax predictions (E7) and the evaluation report (A11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textscore.functions.encode import argmax, log_softmax_at


def exact_match_flag(pred: str, ref: str, ignore_case: bool = True):
    # a null text counts as empty, as in the BLEU lengths
    p, r = F.coalesce(F.col(pred), F.lit("")), F.coalesce(F.col(ref), F.lit(""))
    if ignore_case:
        p, r = F.lower(p), F.lower(r)
    return (p == r).cast("double")


def exact_match(
    pairs: DataFrame,
    pred_col: str = "pred",
    ref_col: str = "ref",
    group_cols: Sequence[str] = (),
    ignore_case: bool = True,
) -> DataFrame:
    """Share of pairs whose texts are equal (0..1); no trimming."""
    flag = exact_match_flag(pred_col, ref_col, ignore_case)
    return pairs.groupBy(*group_cols).agg(
        F.avg(flag).alias("exact_match"),
        F.sum(flag).cast("long").alias("hits"),
        F.count(F.lit(1)).alias("pairs"),
    )


def token_losses(
    logits: DataFrame,
    logits_col: str = "logits",
    target_col: str = "target",
    ignore_index: int | None = 0,
) -> DataFrame:
    """Per position: ``loss`` = -log softmax(logits)[target] and the argmax; positions
    whose target equals ``ignore_index`` are dropped."""
    out = logits
    if ignore_index is not None:
        out = out.where(F.col(target_col) != F.lit(ignore_index))
    return out.withColumn("loss", log_softmax_at(logits_col, target_col)).withColumn(
        "prediction", argmax(logits_col)
    )


def cross_entropy(
    logits: DataFrame,
    logits_col: str = "logits",
    target_col: str = "target",
    ignore_index: int | None = 0,
    batch_col: str | None = None,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Masked mean cross-entropy.

    Without ``batch_col``: pooled mean over kept positions.  With it: the mean
    of per-batch means, as an evaluation loop that averages batch losses does
    (``eval_loss``), next to the pooled mean.
    """
    losses = token_losses(logits, logits_col, target_col, ignore_index)
    if batch_col is None:
        return losses.groupBy(*group_cols).agg(
            F.avg("loss").alias("eval_loss"), F.count(F.lit(1)).alias("positions")
        )
    per_batch = losses.groupBy(*group_cols, batch_col).agg(F.avg("loss").alias("_bl"), F.sum("loss").alias("_bs"), F.count(F.lit(1)).alias("_bn"))
    return per_batch.groupBy(*group_cols).agg(
        F.avg("_bl").alias("eval_loss"),
        (F.sum("_bs") / F.sum("_bn")).alias("pooled_loss"),
        F.sum("_bn").alias("positions"),
        F.count(F.lit(1)).alias("batches"),
    )


def eval_report(metrics: DataFrame, id_cols: Sequence[str] = (), decimals: int = 4) -> DataFrame:
    """Metric columns unpivoted to ``(metric, value)``, names sorted, rounded."""
    ids = list(id_cols)
    values = [c for c in metrics.columns if c not in ids]
    long = metrics.select(*ids, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(
        ids, values, "metric", "value"
    )
    return long.select(*ids, "metric", F.round("value", decimals).alias("value")).orderBy(*ids, "metric")
