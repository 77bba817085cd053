"""Test flow, one-pass evaluation, data versions, idempotent log, folded stream state."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from textscore.operators import encode as E
from textscore.operators.bleu import corpus_bleu
from textscore.operators.evaluation import evaluate
from textscore.operators.flow import predict_test_set
from textscore.session import scratch_path
from textscore.sources import io as IO
from textscore.streaming import evaluation as ST

VOCAB = [("<pad>", 0, True), ("</s>", 1, True), ("<unk>", 2, True), ("<s>", 3, True), ("a", 4, False), ("b", 5, False), ("c", 6, False)]


def vocab_of(spark):
    return spark.createDataFrame(VOCAB, "token string, id int, special boolean")


def copy_predictor():
    def factory():
        def predict(pdf: pd.DataFrame) -> pd.Series:
            assert len(pdf) <= 2
            return pd.Series([np.asarray(x, dtype="int32") for x in pdf["input_ids"]], index=pdf.index)

        return predict

    return factory


def test_flow_predicts_every_record_once(spark):
    rows = [(1, ["a", "b"], ["c"]), (2, [], ["a", "zz", "b"]), (3, ["c"] * 20, []), (3, ["c"] * 20, []), (4, ["b"], ["b"])]
    df = spark.createDataFrame(rows, "id long, code_tokens array<string>, docstring_tokens array<string>")
    df = df.withColumns({"position": F.lit(9), "_copies": F.lit(9), "_side": F.lit(9)})
    got = predict_test_set(df, vocab_of(spark), copy_predictor(), block_size=6, batch_size=2, bos_id=3, eos_id=1).collect()
    texts = sorted((r.id, r.actual_comments, r.generated_comments) for r in got)
    assert texts == [(1, "c", "a b"), (2, "a b", ""), (3, "", "c c c c"), (3, "", "c c c c"), (4, "b", "b")]
    assert sorted(r.position for r in got) == [1, 2, 3, 4, 5] and all(r.batch_id == (r.position - 1) // 2 for r in got)
    with pytest.raises(Exception, match="no token array"):
        predict_test_set(spark.createDataFrame([(1, None, ["a"])], df.schema[:3]), vocab_of(spark), copy_predictor(), 6).collect()
    assert predict_test_set(df.limit(0), vocab_of(spark), copy_predictor(), 6).count() == 0


def test_special_ids_stand_inside_the_block(spark):
    df = spark.createDataFrame([(1, "a b c a b c", ""), (2, "", "b")], "id long, x string, y string")
    got = {r.id: r for r in E.encode_pairs(df, "id", "x", "y", vocab_of(spark), 5, bos_id=3, eos_id=1).collect()}
    assert got[1].input_ids == [3, 4, 5, 6, 1] and got[1].code_attention_mask == [1] * 5
    assert got[1].target_ids == [3, 1, 0, 0, 0] and got[1].docs_attention_mask == [1, 1, 0, 0, 0]
    assert got[2].target_ids == [3, 5, 1, 0, 0]


def test_a_vocabulary_beyond_the_bound_fails(spark):
    assert E.bounded_vocabulary(vocab_of(spark), 7).count() == 7
    with pytest.raises(Exception, match="not broadcast"):
        E.bounded_vocabulary(vocab_of(spark), 6).collect()


def one_hot(i):
    return [5.0 if k == i else 0.0 for k in range(7)]


def test_one_pass_evaluation_and_empty_batches(spark):
    # sequence 2 alone fills a batch and decodes to nothing
    rows = [(0, 0, one_hot(4), 4), (0, 1, one_hot(5), 5), (1, 0, one_hot(6), 4), (1, 1, one_hot(5), 0), (2, 0, one_hot(0), 0), (2, 1, one_hot(1), 1), (3, 0, one_hot(4), 4)]
    df = spark.createDataFrame(rows, "seq_id long, pos int, logits array<double>, target int")
    got = {k: evaluate(df, vocab_of(spark), 1, on_empty=k).first() for k in ("skip", "zero")}
    pairs = [("a b", "a b"), ("c b", "a"), ("", ""), ("a", "a")]
    single = [corpus_bleu(spark.createDataFrame([(1, *p)], "id long, pred string, ref string"), smooth=True, pair_weight=2).first().bleu_score for p in pairs]
    held = [s for s in single if s is not None]
    loss = lambda right: math.log(math.exp(5) + 6) - (5 if right else 0)
    assert got["skip"].eval_loss == pytest.approx((loss(1) + loss(0) + loss(1) + loss(1)) / 4)
    assert got["skip"].eval_bleu_score == pytest.approx(sum(held) / 3) and got["zero"].eval_bleu_score == pytest.approx(sum(held) / 4)
    assert got["skip"].eval_EM_score == 0.75 and got["skip"].batches == 4
    with pytest.raises(Exception, match="zero reference"):
        evaluate(df, vocab_of(spark), 1, on_empty="raise").collect()
    plan = evaluate(df, vocab_of(spark), 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 4 and "logits" not in plan  # the stored sequences only
    assert evaluate(df.limit(0), vocab_of(spark), 2).first().batches == 0


def test_changed_data_is_materialized_anew(spark):
    base, source = scratch_path(spark, "t-version"), scratch_path(spark, "t-source")
    build = lambda: spark.read.parquet(source).selectExpr("sum(id) AS s")
    spark.range(5).write.parquet(source)
    first = IO.materialize(spark, base, {"k": 1}, build, source=spark.read.parquet(source)).first().s
    same = IO.fingerprint({"k": 1}, spark.read.parquet(source)) == IO.fingerprint({"k": 1}, spark.read.parquet(source))
    spark.range(9).write.mode("overwrite").parquet(source)
    again = IO.materialize(spark, base, {"k": 1}, build, source=spark.read.parquet(source)).first().s
    assert same and (first, again) == (10, 36)
    assert IO.data_version(spark.createDataFrame([(1,)], "x int")) is None


def test_a_rerun_leaves_the_metric_log_as_it_was(spark):
    log = scratch_path(spark, "t-log")
    ep = spark.createDataFrame([("r1", 0, 10, 0.5, 0.1), ("r1", 1, 20, 0.6, 0.2), ("a b/c", 0, 5, None, 0.0)], "run string, epoch int, step long, bleu double, em double")
    IO.log_metrics(ep, log)
    IO.log_metrics(ep.where("epoch = 1").select("run", "epoch", "step", F.lit(0.9).alias("loss")), log, log="train")
    before = sorted(map(tuple, IO.read_metric_log(spark, log).collect()), key=repr)
    IO.log_metrics(ep.where("run = 'r1' and epoch = 1"), log)
    after = sorted(map(tuple, IO.read_metric_log(spark, log).collect()), key=repr)
    assert before == after and len(before) == 7


def test_the_metric_log_holds_no_folder_for_each_epoch(spark):
    log = scratch_path(spark, "t-log-many")
    ep = spark.range(400).selectExpr("cast(id % 4 as string) AS run", "cast(id div 4 as int) AS epoch", "id AS step", "id / 8 AS bleu")
    IO.log_metrics(ep, log)
    IO.log_metrics(ep.where("epoch = 7").withColumn("bleu", F.lit(-1.0)), log)
    folders = sum(len(dirs) for _, dirs, _ in os.walk(log.removeprefix("file:")))
    back = IO.read_metric_log(spark, log)
    assert folders < 10 and back.count() == 400
    assert back.where("value < 0").count() == back.where("epoch = 7").count() == 4


def test_a_large_prediction_table_is_many_files(spark):
    p = scratch_path(spark, "t-csv-files")
    df = spark.range(100).selectExpr("id", "concat('line\n', id) AS actual_comments", "'x' AS generated_comments").coalesce(1)
    IO.write_predictions_csv(df, p, rows_per_file=30)
    assert len([f for f in os.listdir(p) if f.startswith("part-")]) == 4
    back = IO.read_predictions_csv(spark, p)
    assert back.count() == 100 and back.where("actual_comments = concat('line\n', id)").count() == 100


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_folded_state_survives_replays_and_equals_batch(spark, groups):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    pairs = docs.select(F.col("doc_id").alias("id"), F.regexp_replace("text", "o", "0").alias("pred"), F.col("text").alias("ref"), (F.col("doc_id") % 2).alias("g"))
    parts = [pairs.where(F.col("id") % 6 == k) for k in range(6)]
    state = scratch_path(spark, "t-fold")
    for k, part in enumerate(parts):
        ST.score_micro_batch(part, k, state, groups, compact_every=2)
        if k == 4:  # the running batch fails after its fold and is replayed; so is one that was folded
            ST.score_micro_batch(part, k, state, groups, compact_every=2)
            ST.score_micro_batch(parts[1], 1, state, groups)
    states, folds = ST._state_log(spark, state)
    assert max(folds) == 3 and min(states) >= 2 and 0 not in states
    # a fold cut short leaves no commit mark: readers do not see it, and it is written again
    os.makedirs(f"{state.removeprefix('file:')}/upto=4")
    order = groups or ["pairs"]
    for _ in range(2):
        got = ST.current_scores(spark, state, groups).orderBy(*order).collect()
        want = corpus_bleu(pairs, group_cols=groups).orderBy(*order).collect()
        for a, b in zip(got, want, strict=True):
            assert a.bleu_score == pytest.approx(b.bleu_score, abs=1e-12) and a.pairs == b.pairs == a.em_rows
        ST.compact(spark, state, 4, groups)
    assert max(ST._state_log(spark, state)[1]) == 4
