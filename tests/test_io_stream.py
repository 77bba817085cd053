import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from textscore.session import scratch_path
from textscore.sources import io as IO


def test_f12_jsonl_blank_lines_and_malformed(spark):
    d = tempfile.mkdtemp(prefix="jsonl-")
    good = os.path.join(d, "good.jsonl")
    with open(good, "w") as f:
        f.write('{"code_tokens": ["a", "b"], "docstring_tokens": ["c"]}\n\n   \n{"code_tokens": [], "docstring_tokens": ["é"]}\n')
    df = IO.read_jsonl(spark, good, IO.REVIEW_SCHEMA)
    assert df.count() == 2
    joined = IO.join_token_columns(df).collect()
    assert sorted(r.code_tokens for r in joined) == ["", "a b"]
    bad = os.path.join(d, "bad.jsonl")
    with open(bad, "w") as f:
        f.write('{"code_tokens": ["a"]}\n{not json\n')
    with pytest.raises(Exception):
        IO.read_jsonl(spark, bad, IO.REVIEW_SCHEMA).collect()


def test_jsonl_sink_keeps_nulls_and_unicode(spark):
    df = spark.createDataFrame([(1, None, "é😀")], "id long, a string, b string")
    p = scratch_path(spark, "t-jsonl")
    IO.write_jsonl(df, p)
    text = "".join(open(os.path.join(p, f), encoding="utf-8").read() for f in os.listdir(p) if f.endswith(".json"))
    assert '"a":null' in text and "é😀" in text


def test_csv_roundtrip_edge_whitespace(spark):
    rows = [(1, "  lead and trail  ", 'quote " and, comma'), (2, "multi\nline", ""), (3, "", "x")]
    df = spark.createDataFrame(rows, "id long, actual_comments string, generated_comments string")
    p = scratch_path(spark, "t-csv")
    IO.write_predictions_csv(df, p)
    back = {r.id: (r.actual_comments, r.generated_comments) for r in IO.read_predictions_csv(spark, p).collect()}
    assert back == {i: (a, g) for i, a, g in rows}


def test_materialize_reuses_and_keys_on_params(spark):
    base = scratch_path(spark, "t-mat")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    a = IO.materialize(spark, base, {"k": 1}, build)
    b = IO.materialize(spark, base, {"k": 1}, build)
    c = IO.materialize(spark, base, {"k": 2}, build)
    assert len(calls) == 2 and a.count() == b.count() == c.count() == 5


def test_split_sources_and_metric_log(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "n_chars").withColumn(
        "split", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train")
    )
    root = scratch_path(spark, "t-splits")
    IO.write_splits(docs, root, fmt="json")
    back = IO.read_splits(spark, {"train": f"{root}/split=train", "test": f"{root}/split=test"}, "doc_id long, n_chars long")
    counts = {r.split: r.rows for r in IO.split_counts(back).collect()}
    assert counts == {r.split: r["count"] for r in docs.groupBy("split").count().collect()}
    log = scratch_path(spark, "t-log")
    ep = spark.createDataFrame([("r1", 0, 10, 0.5, 0.1), ("r1", 1, 20, 0.6, 0.2)], "run string, epoch int, step long, bleu double, em double")
    IO.log_metrics(ep, log)
    IO.log_metrics(ep.withColumn("run", F.lit("r2")), log)
    assert IO.read_metric_log(spark, log).count() == 8


def test_stream_equals_batch(spark):
    from textscore.operators.bleu import corpus_bleu
    from textscore.streaming.evaluation import current_scores, start_stream

    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    pairs = docs.select(F.col("doc_id").alias("id"), F.regexp_replace("text", "e", "a").alias("pred"), F.col("text").alias("ref"))
    src = scratch_path(spark, "t-src")
    pairs.repartitionByRange(4, "id").write.parquet(src)
    state = scratch_path(spark, "t-state")
    q = start_stream(spark, src, state, scratch_path(spark, "t-ckpt"), max_files_per_trigger=1)
    q.awaitTermination()
    s = current_scores(spark, state).first()
    b = corpus_bleu(pairs).first()
    assert s.bleu_score == pytest.approx(b.bleu_score, abs=1e-12) and s.pairs == b.pairs
    assert len([f for f in os.listdir(state.removeprefix("file:")) if f.startswith("mb=")]) >= 2


def test_strict_jsonl_skips_unicode_blank_lines(spark):
    d = tempfile.mkdtemp(prefix="jsonl-strict-")
    p = os.path.join(d, "a.jsonl")
    with open(p, "w", encoding="utf-8") as f:
        f.write('{"code_tokens": ["a"], "docstring_tokens": ["b"]}\n \n　 \n {"code_tokens": [], "docstring_tokens": []} \n')
    assert IO.read_jsonl_strict(spark, p, IO.REVIEW_SCHEMA).count() == 2
    bad = os.path.join(d, "b.jsonl")
    with open(bad, "w", encoding="utf-8") as f:
        f.write('{"code_tokens": ["a"]}\n{broken\n')
    with pytest.raises(Exception):
        IO.read_jsonl_strict(spark, bad, IO.REVIEW_SCHEMA).collect()


def test_micro_batch_replay_is_idempotent(spark):
    from textscore.streaming.evaluation import current_scores, score_micro_batch

    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    pairs = docs.select(F.col("doc_id").alias("id"), F.regexp_replace("text", "o", "0").alias("pred"), F.col("text").alias("ref"))
    a, b = pairs.where("id < 100"), pairs.where("id >= 100")
    state = scratch_path(spark, "t-replay")
    score_micro_batch(a, 0, state)
    score_micro_batch(b, 1, state)
    once = current_scores(spark, state).first()
    score_micro_batch(b, 1, state)  # replayed after a failure
    twice = current_scores(spark, state).first()
    assert once.bleu_score == twice.bleu_score and once.pairs == twice.pairs == pairs.count()
