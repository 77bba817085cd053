"""Rows that the registered tables don't have: repeated and null keys, null dates, no rows."""

import pytest

from textscore.operators import bleu as B
from textscore.operators import checks as C
from textscore.operators import metrics as M
from textscore.operators import ordering as O


def test_pairs_that_share_an_id_are_clipped_apart(spark):
    df = spark.createDataFrame([(1, "a", "b"), (1, "b", "a")], "id long, pred string, ref string")
    r = B.corpus_bleu(df).first()
    assert (r.bleu_score, r.pairs) == (0.0, 2)


def test_copies_of_a_pair_count_each(spark):
    rows = [(1, "the cat sat on the mat .", "the cat is on the mat .")] * 3
    shared = B.corpus_bleu(spark.createDataFrame(rows, "id long, pred string, ref string"), smooth=True).first()
    apart = B.corpus_bleu(spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "id long, pred string, ref string"), smooth=True).first()
    assert shared == apart and shared.pairs == 3
    grouped = spark.createDataFrame([(*r, g) for g in "xxy" for r in rows[:1]], "id long, pred string, ref string, g string")
    got = {r.g: r.pairs for r in B.corpus_bleu(grouped, group_cols=["g"]).collect()}
    assert got == {"x": 2, "y": 1}


def test_null_keys_are_numbered(spark):
    rows = [("p", 1), ("p", 2), (None, 3), (None, None), ("p", None)]
    got = O.row_number_by(spark.createDataFrame(rows, "p string, k long"), ["k"], ["p"]).collect()
    assert sorted((r.p or "", r.rn) for r in got) == [("", 1), ("", 2), ("p", 1), ("p", 2), ("p", 3)]


def test_string_and_fractional_keys(spark):
    words = [f"w{i:03d}" for i in range(50)]
    got = O.row_number_by(spark.createDataFrame([(w,) for w in words], "k string"), ["k"]).collect()
    assert {r.k: r.rn for r in got} == {w: i + 1 for i, w in enumerate(words)}
    small = O.row_number_by(spark.createDataFrame([(i / 1000,) for i in range(1000)], "k double"), ["k"]).collect()
    assert all(r.rn == round(r.k * 1000) + 1 for r in small)


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows_are_sorted(spark, n):
    df = spark.createDataFrame([(1, "2020-01-01T00:00:00Z")], "pos long, date string").limit(n)
    r = C.sorted_by_date(df, "pos").first()
    assert r.sorted and r.rows == n


def test_null_date_fails_the_leak_check(spark):
    df = spark.createDataFrame([(1, "train", None), (2, "test", "2019-01-01T00:00:00Z")], "pos long, split string, date string")
    with pytest.raises(Exception, match="null date"):
        C.leak_check(df, "pos").collect()


def test_target_outside_the_logits_fails(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2, 0.3], 7)], "id long, logits array<double>, target int")
    with pytest.raises(Exception, match="outside"):
        M.cross_entropy(df).collect()


def test_null_texts_count_as_empty(spark):
    df = spark.createDataFrame([("a", "a"), (None, "b"), ("", None)], "pred string, ref string")
    r = M.exact_match(df).first()
    assert (r.hits, r.pairs) == (2, 3) and abs(r.exact_match - 2 / 3) < 1e-12


def test_inputs_are_not_dealt_out_by_size(spark):
    from textscore.plans.inputs import table

    plan = table(spark, "/root/testdata/sf0.001", "documents")._jdf.queryExecution().toString()
    assert "RoundRobin" not in plan
