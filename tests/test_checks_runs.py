import random

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from textscore.operators import checks as C
from textscore.operators import ordering as O
from textscore.operators import runs as R


def test_f13_sorted_checks(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    assert C.sorted_by_date(ev, "event_id", "ts").first().violations == 0
    r = C.sorted_by_date(o, "o_orderkey", "o_orderdate").first()
    assert (r.sorted, r.violations) == (False, 7439)


def test_bucketed_lag_equals_plain_lag(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 50), rng.choice("ab")) for i in range(3000)]
    df = spark.createDataFrame(rows, "pos long, v long, g string")
    got = {r.g: r.violations for r in O.order_violations(df, "pos", "v", ["g"]).collect()}
    for g in "ab":
        seq = [v for p, v, gg in rows if gg == g]
        assert got[g] == sum(1 for a, b in zip(seq, seq[1:]) if a > b)


def test_row_number_by_equals_python(spark):
    rng = random.Random(9)
    ids = rng.sample(range(100000), 2000)
    df = spark.createDataFrame([(i, i % 7) for i in ids], "k long, p long")
    got = {r.k: r.rn for r in O.row_number_by(df, ["k"], ["p"], bucket=F.expr("k div 4321")).collect()}
    for p in range(7):
        ks = sorted(k for k in ids if k % 7 == p)
        assert all(got[k] == i + 1 for i, k in enumerate(ks))


def test_f9_leak_check_equal_boundary(spark):
    df = spark.createDataFrame(
        [(1, "train", "2024-01-01T00:00:00Z"), (2, "train", "2024-1-2T0:0:0Z"), (3, "test", "2024-01-02T00:00:00Z"), (4, "test", "2024-01-03T00:00:00Z")],
        "id long, split string, date string",
    )
    r = C.leak_check(df, "id").first()
    assert r.ok and r.reason == "ok"
    leak = df.withColumn("date", F.when(F.col("id") == 2, "2024-01-05T00:00:00Z").otherwise(F.col("date")))
    assert C.leak_check(leak, "id").first().reason == "leak"
    unsorted = df.withColumn("date", F.when(F.col("id") == 1, "2024-01-09T00:00:00Z").otherwise(F.col("date")))
    assert C.leak_check(unsorted, "id").first().reason == "train_unsorted"


def test_unparsable_date_raises(spark):
    df = spark.createDataFrame([(1, "train", "not a date"), (2, "test", "2024-01-01T00:00:00Z")], "id long, split string, date string")
    with pytest.raises(Exception):
        C.leak_check(df, "id").collect()


def _loop_patience(bleu, em, max_patience=-1):
    best_b = best_e = 0.0
    patience, out, stop = 0, [], None
    for t, (b, e) in enumerate(zip(bleu, em)):
        if b > best_b:
            best_b, patience = b, 0
        else:
            patience += 1
        if e > best_e:
            best_e, patience = e, 0
        else:
            patience += 1
        out.append(patience)
        if stop is None and patience == max_patience:
            stop = t
    return out, stop


def test_f8_patience(spark):
    df = spark.createDataFrame([("r", i, b, e) for i, (b, e) in enumerate(zip([0.1, 0.2, 0.2, 0.1], [0.0, 0.0, 0.1, 0.1]))], "run string, epoch int, bleu double, em double")
    got = [r.patience for r in R.epoch_progress(df).orderBy("epoch").collect()]
    assert got == [1, 1, 0, 2]


def test_patience_closed_form_random(spark):
    rng = random.Random(3)
    rows, expect = [], {}
    for run in range(60):
        n = rng.randint(1, 12)
        b = [rng.choice([0.0, 0.1, 0.2, 0.3]) for _ in range(n)]
        e = [rng.choice([0.0, 0.1, 0.2]) for _ in range(n)]
        expect[run] = _loop_patience(b, e, 4)
        rows += [(run, i, b[i], e[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "run long, epoch int, bleu double, em double")
    prog = R.epoch_progress(df, max_patience=4).collect()
    got = {}
    for r in sorted(prog, key=lambda r: (r.run, r.epoch)):
        got.setdefault(r.run, ([], r.stop_epoch))[0].append(r.patience)
    for run, (pat, stop) in expect.items():
        assert got[run][0] == pat and got[run][1] == stop


def test_f11_interval_perplexity(spark):
    df = spark.createDataFrame([("r", 1, 1.0), ("r", 2, 2.0), ("r", 3, 3.0)], "run string, global_step long, loss double")
    got = [r.perplexity for r in R.interval_perplexity(df, 2).orderBy("global_step").collect()]
    assert got == [2.7183, 4.4817, 20.0855]


def test_best_epochs_and_stop(spark):
    df = spark.createDataFrame([("r", i, b, 0.0) for i, b in enumerate([0.1, 0.3, 0.2, 0.2, 0.2, 0.5])], "run string, epoch int, bleu double, em double")
    prog = R.epoch_progress(df, max_patience=5)
    best = R.best_epochs(prog).first()
    # patience: 1,1,3,5 -> stop at epoch 3; best BLEU before stop is epoch 1
    assert best.stop_epoch == 3 and best.best_bleu_epoch == 1 and best.best_em_epoch is None


def test_global_steps_and_running_loss(spark):
    df = spark.createDataFrame([("r", e, s, float(e * 10 + s)) for e in range(3) for s in range(1, 5)], "run string, epoch int, step long, loss double")
    g = R.global_steps(df).orderBy("epoch", "step").collect()
    assert [r.global_step for r in g] == list(range(1, 13))
    rl = R.running_loss(df).where("epoch = 1").orderBy("step").collect()
    assert [r.avg_loss for r in rl] == [11.0, 11.5, 12.0, 12.5]


def test_ordered_checks_of_common_prefix_strings_run_no_job_while_planned(spark):
    rng = random.Random(12)
    rows = [(f"a-long-common-prefix/{i:06d}", i + rng.choice([0, 0, -9]), "ab"[i % 3 == 0]) for i in range(3000)]
    df = spark.createDataFrame(rows, "pos string, v long, g string").repartition(5)
    jobs = lambda: set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = jobs()
    planned = O.order_violations(df, "pos", "v", ["g"])
    assert jobs() == before
    got = {r.g: r for r in planned.collect()}
    for g in "ab":
        seq = [(p, v) for p, v, gg in rows if gg == g]
        bad = [p for (_, x), (p, y) in zip(seq, seq[1:]) if x > y]
        r = got[g]
        assert (r.rows, r.violations, r.first_violation_pos, r.first_value, r.last_value) == (len(seq), len(bad), bad[0], seq[0][1], seq[-1][1])
    tasks = spark.createDataFrame(rows, "pos string, v long, g string").repartitionByRange(4, "pos").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 1500


def test_half_even_rounding_option(spark):
    from decimal import Decimal

    df = spark.createDataFrame([("r", 0, 1, Decimal("0.000015")), ("r", 0, 2, Decimal("0.000025"))], "run string, epoch int, step long, loss decimal(12,6)")
    up = [r.avg_loss for r in R.running_loss(df).orderBy("step").collect()]
    even = [r.avg_loss for r in R.running_loss(df, half_even=True).orderBy("step").collect()]
    assert [float(x) for x in up] == [0.00002, 0.00002] and [float(x) for x in even] == [0.00002, 0.00002]
    ties = spark.createDataFrame([("r", 0, 1, Decimal("0.000025"))], "run string, epoch int, step long, loss decimal(12,6)")
    assert float(R.running_loss(ties).first().avg_loss) == 0.00003
    assert float(R.running_loss(ties, half_even=True).first().avg_loss) == 0.00002


def test_md5_buckets_any_width_give_global_order(spark):
    import hashlib

    df = spark.range(3000).withColumnRenamed("id", "k")
    x = df.withColumn("o", F.md5(F.concat(F.lit("42:"), F.col("k").cast("string"))))
    expect = {k: i + 1 for i, k in enumerate(sorted(range(3000), key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest()))}
    for digits in (1, 3, 5):
        got = {r.k: r.rn for r in O.row_number_by(x, ["o"], bucket=O.md5_bucket(F.col("o"), digits)).collect()}
        assert got == expect
