import pytest
from pyspark.sql import functions as F

from conftest import SF001
from textscore.functions.encode import argmax, attention_mask, truncate_pad
from textscore.operators import batches as BT
from textscore.operators import encode as E
from textscore.operators import metrics as M
from textscore.operators.infer import argmax_predictor, predict_batches


def test_f10_truncate_pad(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([5, 6, 7, 8, 9, 4],)], "ids array<int>")
    r = df.select(truncate_pad("ids", 5, 0).alias("x"), attention_mask("ids", 5).alias("m")).collect()
    assert r[0].x == [5, 6, 7, 0, 0] and r[0].m == [1, 1, 1, 0, 0]
    assert r[1].x == [5, 6, 7, 8, 9] and r[1].m == [1] * 5


def test_vocab_encode_decode_roundtrip(spark):
    docs = spark.createDataFrame([(1, "b a b c"), (2, "c c zz"), (3, "")], "id long, text string")
    v = E.build_vocabulary(docs, "text", top_k=3)
    vocab = {r.token: r.id for r in v.collect()}
    assert vocab == {"<pad>": 0, "</s>": 1, "<unk>": 2, "c": 3, "b": 4, "a": 5}
    enc = {r.id: r.input_ids for r in E.encode(docs, "id", "text", v).collect()}
    assert enc == {1: [4, 5, 4, 3], 2: [3, 3, 2], 3: []}
    dec = {r.id: r.text for r in E.decode(E.encode(docs, "id", "text", v), "id", "input_ids", v).collect()}
    assert dec == {1: "b a b c", 2: "c c", 3: ""}


def test_repeated_ids_stay_rows_of_their_own(spark):
    rows = [(1, "b a"), (1, "c c"), (1, "c c"), (None, "a"), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "id long, text string")
    v = E.build_vocabulary(docs, "text", top_k=3)
    enc = E.encode(docs, "id", "text", v)
    got = sorted(((r.id, r.text) for r in E.decode(enc, "id", "input_ids", v).collect()), key=repr)
    assert got == sorted([(i, t or "") for i, t in rows], key=repr)
    pairs = E.encode_pairs(docs.withColumn("doc", F.col("text")), "id", "text", "doc", v, 2)
    assert pairs.count() == len(rows) and pairs.where("size(input_ids) <> 2").count() == 0


def test_pad_fallback(spark):
    v = spark.createDataFrame([("</s>", 1), ("<unk>", 2), ("x", 3)], "token string, id int")
    r = E.resolve_pad(v).first()
    assert (r.pad_token, r.pad_id) == ("</s>", 1)


def test_encoded_pairs_layout(spark):
    docs = spark.createDataFrame([(1, "a b", "c"), (2, "a a a a a a", "")], "id long, code string, doc string")
    v = E.build_vocabulary(docs.select(F.concat_ws(" ", "code", "doc").alias("t")), "t", 10)
    out = E.encode_pairs(docs, "id", "code", "doc", v, 4).orderBy("id").collect()
    assert out[0].asDict().keys() >= {"input_ids", "code_attention_mask", "target_ids", "docs_attention_mask"}
    assert len(out[1].input_ids) == 4 and out[1].code_attention_mask == [1, 1, 1, 1] and out[1].docs_attention_mask == [0, 0, 0, 0]


def test_batches_and_epoch_plan(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select(F.col("doc_id").alias("id"))
    b = BT.assign_batches(docs, "id", 64).collect()
    assert sorted(r.position for r in b) == list(range(1, 1001))
    assert max(r.batch_id for r in b) == 15
    plan = BT.epoch_plan(docs.withColumn("split", F.lit("train")), 64, 5).first()
    assert (plan.steps_per_epoch, plan.total_steps, plan.nominal_examples) == (16, 80, 1024)
    ordered = BT.assign_batches(docs, "id", 64, shuffle=False).collect()
    assert all(r.position == r.id + 1 for r in ordered)


def test_f7_exact_match(spark):
    df = spark.createDataFrame([("Fix Bug", "fix bug"), ("a ", "a"), ("x", "y")], "pred string, ref string")
    assert M.exact_match(df).first().exact_match == pytest.approx(1 / 3)


def test_f14_cross_entropy_and_argmax(spark):
    lg = spark.read.parquet(f"{SF001}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("logits"), F.col("label").alias("target"))
    assert M.cross_entropy(lg).first().eval_loss == pytest.approx(4.1664373805, abs=1e-9)
    assert lg.where(argmax("logits") == F.col("target")).count() == 15


def test_batch_predictor_matches_argmax(spark):
    lg = spark.read.parquet(f"{SF001}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("logits"))
    out = predict_batches(lg, argmax_predictor("logits"), "id", ["logits"], out_type="int", batch_size=7)
    joined = out.join(lg.select("id", argmax("logits").alias("a")), "id")
    assert joined.where(F.col("prediction") != F.col("a")).count() == 0 and joined.count() == 500


def test_eval_report_sorted(spark):
    df = spark.createDataFrame([(0.123456, 2.0)], "eval_loss double, eval_bleu_score double")
    assert [(r.metric, r.value) for r in M.eval_report(df).collect()] == [("eval_bleu_score", 2.0), ("eval_loss", 0.1235)]


def test_effective_block_size():
    from textscore.functions.encode import effective_block_size

    assert effective_block_size(0, 512) == 512
    assert effective_block_size(1024, 512) == 512
    assert effective_block_size(1024, 512, cap=False) == 1024
    assert effective_block_size(256, 512) == 256


def test_truncate_with_end_token(spark):
    df = spark.createDataFrame([([5, 6, 7, 8, 9],), ([5],)], "ids array<int>")
    r = df.select(truncate_pad("ids", 4, 0, eos_id=1).alias("x"), attention_mask("ids", 4, eos_id=1).alias("m")).collect()
    assert r[0].x == [5, 6, 7, 1] and r[0].m == [1, 1, 1, 1]
    assert r[1].x == [5, 1, 0, 0] and r[1].m == [1, 1, 0, 0]
