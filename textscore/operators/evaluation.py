"""The evaluation loop as one plan: per-position logits -> metrics per batch.

Per batch the reference decodes argmax predictions and targets to text,
scores smoothed BLEU (every pair counted twice, as its wrapper does) and
case-insensitive exact match, and takes the masked cross-entropy; the result
is the unweighted mean over batches.  Here the batches are rows sharing a
``batch_id`` and every step is a grouped aggregation, so all batches are
scored at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textscore.functions.encode import argmax, log_softmax_at
from textscore.operators.bleu import corpus_bleu
from textscore.operators.encode import bounded_vocabulary
from textscore.operators.metrics import exact_match_flag
from textscore.operators.scan import number_rows


def decoded(pos_col: str, token: str, special: str) -> Column:
    """E6 as an aggregate over a sequence's positions: special and unknown ids are
    skipped; with nothing left it is ''."""
    keep = F.col(token).isNotNull() & ~F.coalesce(F.col(special), F.lit(False))
    piece = F.when(keep, F.struct(F.col(pos_col).alias("p"), F.col(token).alias("t")))
    return F.array_join(F.sort_array(F.collect_list(piece))["t"], " ")


def score_sequences(positions: DataFrame, vocab: DataFrame, seq_col: str, pos_col: str, logits_col: str, target_col: str, ignore_index: int) -> DataFrame:
    """One row a sequence: ``pred`` and ``ref`` as text, the sum of its losses and their count."""
    pos = positions.select(
        seq_col,
        pos_col,
        target_col,
        argmax(logits_col).alias("_pred"),
        F.when(F.col(target_col) != ignore_index, log_softmax_at(logits_col, target_col)).alias("_loss"),
    )
    for side, ids in (("p", "_pred"), ("r", target_col)):
        words = vocab.select(F.col("id").alias(f"_{side}_id"), F.col("token").alias(f"_{side}_token"), F.col("special").alias(f"_{side}_special"))
        pos = pos.join(bounded_vocabulary(words), F.col(ids) == F.col(f"_{side}_id"), "left")
    return pos.groupBy(seq_col).agg(
        decoded(pos_col, "_p_token", "_p_special").alias("pred"),
        decoded(pos_col, "_r_token", "_r_special").alias("ref"),
        F.sum("_loss").alias("loss_sum"),
        F.count("_loss").alias("loss_n"),
    )


def evaluate(
    positions: DataFrame,
    vocab: DataFrame,
    batch_size: int,
    *,
    seq_col: str = "seq_id",
    pos_col: str = "pos",
    logits_col: str = "logits",
    target_col: str = "target",
    ignore_index: int = 0,
    smooth: bool = True,
    pair_weight: int = 2,
    tokenizer: str = "13a",
    on_empty: str = "skip",
) -> DataFrame:
    """One row: ``eval_loss``, ``eval_bleu_score``, ``eval_EM_score`` (means over
    batches) and ``batches``.  Batches follow sequence order (no shuffle, as for
    validation).

    The positions are read once: they become one row a sequence, which is stored with
    its number, and every metric follows from those rows.  A batch without a reference
    or predicted token has no BLEU: with ``on_empty`` ``"skip"`` it is left out of the
    BLEU mean, with ``"zero"`` it counts 0, with ``"raise"`` the job fails.
    """
    if on_empty not in ("skip", "zero", "raise"):
        raise ValueError(f"on_empty: {on_empty}")
    rows = score_sequences(positions, vocab, seq_col, pos_col, logits_col, target_col, ignore_index)
    rows = number_rows(rows, [seq_col], out_col="_n").withColumnRenamed(seq_col, "id")
    pairs = rows.withColumn("batch_id", F.expr(f"(_n - 1) div {batch_size}"))
    bleu = corpus_bleu(
        pairs, group_cols=["batch_id"], smooth=smooth, pair_weight=pair_weight, tokenizer=tokenizer, on_empty="raise" if on_empty == "raise" else "null"
    )
    rest = pairs.groupBy("batch_id").agg(
        F.try_divide(F.sum("loss_sum"), F.sum("loss_n")).alias("loss"), F.avg(exact_match_flag("pred", "ref")).alias("em")
    )
    per_batch = rest.join(bleu.select("batch_id", "bleu_score"), "batch_id", "left")
    score = F.coalesce("bleu_score", F.lit(0.0)) if on_empty == "zero" else F.col("bleu_score")
    return per_batch.agg(
        F.avg("loss").alias("eval_loss"),
        F.coalesce(F.avg(score), F.lit(0.0)).alias("eval_bleu_score"),
        F.coalesce(F.avg("em"), F.lit(0.0)).alias("eval_EM_score"),
        F.count(F.lit(1)).alias("batches"),
    )
