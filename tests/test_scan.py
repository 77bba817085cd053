"""Range-wise numbering and scans against plain loops, hot and null keys included."""

import random

from pyspark.sql import functions as F

from textscore.operators.scan import number_rows, running_sums


def test_row_numbers_of_hot_null_and_common_prefix_keys(spark):
    rng = random.Random(3)
    rows = [("hot", f"same-long-prefix/{rng.randrange(10**9):09d}", i) for i in range(3000)]
    rows += [(rng.choice(["a", "b", None]), rng.choice([None, f"k{i}"]), i) for i in range(3000, 3300)]
    df = spark.createDataFrame(rows, "p string, o string, id long").repartition(7)
    got = {r.id: r.rn for r in number_rows(df, ["o", "id"], ["p"]).collect()}
    want = {}
    for p in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == p), key=lambda r: (r[1] is not None, r[1] or "", r[2]))
        want |= {r[2]: n + 1 for n, r in enumerate(own)}
    assert got == want
    whole = {r.id: r.rn for r in number_rows(df, ["id"]).collect()}
    assert whole == {i: i + 1 for i in range(3300)}
    spread = number_rows(df, ["o", "id"], ["p"])
    assert spread.columns == ["p", "o", "id", "rn"]
    assert number_rows(df.limit(0), ["id"], ["p"]).count() == 0


def test_running_sums_cross_ranges(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.choice([None, rng.randrange(100)])) for k, n in (("hot", 2000), (None, 37), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, v long").withColumn("r", F.col("i").cast("long") / 64).withColumn("r", F.floor("r"))
    got = {(r.k, r.i): r.s for r in running_sums(df, ["k"], ["i"], ["r"], {"s": "v"}).collect()}
    for k in ("hot", None, "one"):
        total = None
        for _, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            total = total if v is None else (total or 0) + v
            assert got[k, i] == total


def loop_of_run(rows, max_patience, logging_steps):
    """The training loop's own bookkeeping, one epoch after the other."""
    best_b = best_e = 0.0
    patience, stop, out = 0, None, []
    for epoch, b, e in rows:
        flags = []
        for better in (b is not None and b > best_b, e is not None and e > best_e):
            patience = 0 if better else patience + 1
            flags.append(better)
        best_b, best_e = max(best_b, b or 0), max(best_e, e or 0)
        out.append((epoch, *flags, patience))
        if stop is None and patience == max_patience:
            stop = epoch
    return out, stop


def test_epoch_progress_of_one_hot_run_across_ranges(spark, monkeypatch):
    from textscore.operators import runs, scan

    monkeypatch.setattr(scan, "RANGE", 16)
    rng = random.Random(8)
    data = {}
    for run, n in (("hot", 900), (None, 40), ("short", 3), ("still", 50)):
        top = 0.0
        data[run] = []
        for i in range(n):
            top += 0.001 if rng.random() < 0.03 else 0
            data[run].append((i, 0.0 if run == "still" else round(top - rng.random() * 0.0005, 6) if rng.random() < 0.5 else round(top, 6), round(rng.random() * 0.3, 2)))
    rows = [(run, *r) for run, rs in data.items() for r in rs]
    df = spark.createDataFrame(rows, "run string, epoch int, bleu double, em double").repartition(6)
    for limit in (5, 60, -1):
        got = {(r.run, r.epoch): r for r in runs.epoch_progress(df, max_patience=limit).collect()}
        assert len(got) == len(rows)
        for run, rs in data.items():
            want, stop = loop_of_run(rs, limit, 0)
            for epoch, bb, be, patience in want:
                r = got[run, epoch]
                assert (r.best_bleu, r.best_em, r.patience, r.stop_epoch, r.milestone) == (bb, be, patience, stop if limit >= 0 else None, epoch == 9)
                assert r.stopped_here == (limit >= 0 and epoch == stop)


def test_steps_of_one_hot_epoch_across_ranges(spark, monkeypatch):
    from textscore.operators import runs, scan

    monkeypatch.setattr(scan, "RANGE", 16)
    monkeypatch.setattr(runs, "RANGE", 16)
    rng = random.Random(9)
    rows = [("hot", 0, s, rng.randrange(1, 400) / 100) for s in range(700)]
    rows += [("hot", e, s, rng.randrange(1, 400) / 100) for e in range(1, 60) for s in range(rng.randint(1, 4))]
    rows += [(None, e, s, 1.0) for e in range(3) for s in range(2)]
    df = spark.createDataFrame(rows, "run string, epoch int, step long, loss double").repartition(5)
    numbered = runs.global_steps(df)
    got = {(r.run, r.epoch, r.step): r.global_step for r in numbered.collect()}
    means = {(r.run, r.epoch, r.step): r.avg_loss for r in runs.running_loss(df).collect()}
    tables = {k: {(r.run, r.global_step): r.perplexity for r in runs.interval_perplexity(numbered, k).collect()} for k in (0, 10, 16, 50)}
    import math

    for run in ("hot", None):
        own = sorted(r[1:] for r in rows if r[0] == run)
        total, epoch_sums = {k: [] for k in tables}, {}
        for i, (epoch, step, loss) in enumerate(own):
            assert got[run, epoch, step] == i + 1
            seen = epoch_sums.setdefault(epoch, [])
            seen.append(loss)
            assert abs(means[run, epoch, step] - sum(seen) / len(seen)) < 1e-5
            for k, part in total.items():
                if k and i % k == 0:
                    part.clear()
                part.append(loss)
                assert abs(tables[k][run, i + 1] - math.exp(sum(part) / len(part))) < 1e-3
    assert runs.running_loss(df.limit(0)).count() == runs.global_steps(df.limit(0)).count() == 0
