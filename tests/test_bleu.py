import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import pyref
from textscore.functions.text import tokenize_13a
from textscore.operators import bleu as B


def _one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_f1_multi_reference_readme(spark):
    df = spark.createDataFrame(
        [(0, "hello there general kenobi", ["hello there general kenobi", "hello there !"]), (1, "foo bar foobar", ["foo bar foobar"])],
        "id long, pred string, ref array<string>",
    )
    r = _one(B.corpus_bleu(df))
    assert r.bleu_score == 1.0 and r.precisions == [1.0] * 4 and r.brevity_penalty == 1.0
    assert r.length_ratio == pytest.approx(7 / 6) and r.translation_length == 7 and r.reference_length == 6


def test_f2_single_reference_readme(spark):
    df = spark.createDataFrame([(0, "hello there general kenobi", "hello there general kenobi"), (1, "foo bar foobar", "foo bar foobar")], "id long, pred string, ref string")
    r = _one(B.corpus_bleu(df))
    assert r.bleu_score == 1.0 and r.length_ratio == 1.0 and r.translation_length == 7 and r.reference_length == 7


def test_f3_smoothing_and_pair_weight(spark):
    df = spark.createDataFrame([(0, "the cat sat on the mat .", "the cat is on the mat ."), (1, "a b", "a c")], "id long, pred string, ref string")
    assert _one(B.corpus_bleu(df, smooth=True)).bleu_score == pytest.approx(0.5623413252, abs=1e-9)
    assert _one(B.corpus_bleu(df, smooth=True, pair_weight=2)).bleu_score == pytest.approx(0.5175904364, abs=1e-9)
    comp = _one(B.bleu_components(df))
    assert comp.matches == [7, 4, 2, 1]


def test_f4_zero_precision(spark):
    df = spark.createDataFrame([(0, "a b", "a c")], "id long, pred string, ref string")
    r = _one(B.corpus_bleu(df))
    assert r.bleu_score == 0.0 and r.precisions == [0.5, 0.0, 0.0, 0.0]


def test_empty_reference_gives_null_or_raises(spark):
    df = spark.createDataFrame([(0, "a b", "")], "id long, pred string, ref string")
    assert _one(B.corpus_bleu(df)).bleu_score is None
    with pytest.raises(Exception):
        B.corpus_bleu(df, on_empty="raise").collect()


def _random_corpus(rng, n, vocab="a b c d e f . , 1 2".split()):
    def seg():
        return " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 12)))

    preds, refs = [], []
    for i in range(n):
        preds.append(seg())
        refs.append([seg() or "z" for _ in range(rng.randint(1, 3))])
    return preds, refs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_python_loop(spark, seed):
    rng = random.Random(seed)
    preds, refs = _random_corpus(rng, 40)
    tp = [pyref.tok_13a(p) for p in preds]
    tr = [[pyref.tok_13a(r) for r in rs] for rs in refs]
    for smooth in (False, True):
        exp = pyref.bleu(tr, tp, smooth=smooth)
        # long form (several references per id)
        pdf = spark.createDataFrame([(i, p) for i, p in enumerate(preds)], "id long, pred string")
        rdf = spark.createDataFrame([(i, j, r) for i, rs in enumerate(refs) for j, r in enumerate(rs)], "id long, _ref_no long, ref string")
        got = _one(B.corpus_bleu(pdf, rdf, smooth=smooth))
        assert got.bleu_score == pytest.approx(exp[0], abs=1e-12)
        assert got.precisions == pytest.approx(exp[1], abs=1e-12)
        assert (got.translation_length, got.reference_length) == (exp[4], exp[5])
        # row pairs with the first reference only
        exp1 = pyref.bleu([[r[0]] for r in tr], tp, smooth=smooth)
        rows = spark.createDataFrame([(i, p, refs[i][0]) for i, p in enumerate(preds)], "id long, pred string, ref string")
        got1 = _one(B.corpus_bleu(rows, smooth=smooth))
        assert got1.bleu_score == pytest.approx(exp1[0], abs=1e-12)


def test_identical_pairs_score_one_and_bounds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("pred"), F.col("text").alias("ref"))
    assert _one(B.corpus_bleu(docs)).bleu_score == pytest.approx(1.0)
    per = B.corpus_bleu(docs.withColumn("pred", F.substring("pred", 1, 200)), group_cols=["id"]).collect()
    assert all(r.bleu_score is None or 0.0 <= r.bleu_score <= 1.0 for r in per)


def test_merged_partials_equal_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    near = docs.select(F.col("doc_id").alias("id"), F.regexp_replace("text", " the ", " a ").alias("pred"), F.col("text").alias("ref"))
    whole = _one(B.corpus_bleu(near, smooth=True))
    parts = B.bleu_components(near.withColumn("chunk", F.col("id") % 5), group_cols=["chunk"])
    merged = _one(B.bleu_finalize(B.merge_components(parts), smooth=True))
    assert merged.bleu_score == pytest.approx(whole.bleu_score, abs=1e-12)
    assert merged.translation_length == whole.translation_length


def test_long_form_equals_row_form(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select(F.col("doc_id").alias("id"), "lang", F.regexp_replace("text", "e", "a").alias("pred"), F.col("text").alias("ref"))
    a = {r.lang: r.bleu_score for r in B.corpus_bleu(rows, group_cols=["lang"]).collect()}
    b = {r.lang: r.bleu_score for r in B.corpus_bleu(rows.select("id", "lang", "pred"), rows.select("id", "ref"), group_cols=["lang"]).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)


def test_pairing_reports_unmatched(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b")], "id long, pred string")
    r = spark.createDataFrame([(2, "b"), (3, "c")], "id long, ref string")
    paired, lp, lr = B.pair_predictions(p, r)
    assert (paired.count(), lp.count(), lr.count()) == (1, 1, 1)
    got = _one(B.corpus_bleu(p, r, tokenizer="whitespace"))
    assert got.pairs == 1 and got.bleu_score == 0.0 or got.pairs == 1


def test_pandas_udf_tokenizer_uses_array_grams(spark):
    import pandas as pd

    from textscore.functions.text import gram_key_is_string, register_tokenizer

    @F.pandas_udf("array<string>")
    def py_split(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t.split())

    register_tokenizer("py_split", py_split)  # not declared space-safe
    assert not gram_key_is_string("py_split")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select(F.col("doc_id").alias("id"), F.regexp_replace("text", "a", "e").alias("pred"), F.col("text").alias("ref"))
    a = _one(B.corpus_bleu(rows, tokenizer="py_split"))
    b = _one(B.corpus_bleu(rows, tokenizer="whitespace"))
    assert a.bleu_score == pytest.approx(b.bleu_score, abs=1e-12) and a.translation_length == b.translation_length


def test_hot_id_with_many_references(spark):
    # one prediction owns most of the references (a third of all rows or more)
    rng = random.Random(11)
    vocab = "a b c d e f g . ,".split()

    def seg(k):
        return " ".join(rng.choice(vocab) for _ in range(k))

    preds = {i: seg(rng.randint(3, 10)) for i in range(30)}
    refs = [(0, j, seg(rng.randint(2, 12))) for j in range(600)]
    refs += [(i, 0, seg(rng.randint(2, 12))) for i in range(1, 30)]
    pdf = spark.createDataFrame(list(preds.items()), "id long, pred string")
    rdf = spark.createDataFrame(refs, "id long, _ref_no long, ref string").repartition(8)
    got = _one(B.corpus_bleu(pdf, rdf, smooth=True))
    by_id = {}
    for i, _, r in refs:
        by_id.setdefault(i, []).append(pyref.tok_13a(r))
    ids = sorted(preds)
    exp = pyref.bleu([by_id[i] for i in ids], [pyref.tok_13a(preds[i]) for i in ids], smooth=True)
    assert got.bleu_score == pytest.approx(exp[0], abs=1e-12)
    assert (got.translation_length, got.reference_length, got.pairs) == (exp[4], exp[5], 30)


def test_result_carries_tokenizer_signature(spark):
    df = spark.createDataFrame([(0, "a b", "a b")], "id long, pred string, ref string")
    assert _one(B.corpus_bleu(df)).tokenizer == "13a"
    assert _one(B.corpus_bleu(df, tokenizer="none")).tokenizer == "none"


def test_text_group_columns_come_from_one_read(spark):
    rows = [(i, "a b c", "a b d", f"l{i % 2}", None if i % 3 else "x") for i in range(12)] + [(0, "a b c", "a b c", "l1", "x")]
    df = spark.createDataFrame(rows, "id long, pred string, ref string, n string, lang string")
    comp = B.bleu_components(df, group_cols=["n", "lang"])
    assert comp._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    got = {(r["n"], r["lang"]): (r["pairs"], r["matches"][0], r["translation_length"]) for r in comp.collect()}
    assert got == {("l0", "x"): (2, 4, 6), ("l1", "x"): (3, 7, 9), ("l0", None): (4, 8, 12), ("l1", None): (4, 8, 12)}


def test_row_pairs_are_clipped_without_moving_their_grams(spark, monkeypatch):
    from textscore.operators import clip

    rng = random.Random(9)
    words = "a b c , é".split()
    rows = [(i % 5 or None, i % 3, " ".join(rng.choices(words, k=rng.randint(0, 15))) or None, " ".join(rng.choices(words, k=9))) for i in range(60)]
    rows += rows[:7]
    df = spark.createDataFrame(rows, "id long, g int, pred string, ref string")
    monkeypatch.setattr(clip, "BLOCK", 40)
    assert list(clip._blocks(clip.np.array([30, 10, 1, 90, 0, 5]))) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    for tokenizer in ("13a", lambda c: F.split(F.coalesce(c, F.lit("")), " ")):
        parts = B.bleu_components(df, group_cols=["g"], tokenizer=tokenizer)
        assert "Generate" not in parts._jdf.queryExecution().toString()
        got = {r.g: r for r in parts.collect()}
        for g in range(3):
            tok = pyref.tok_13a if tokenizer == "13a" else lambda x: x.split(" ")
            ps, rs = ([tok(r[k] or "") for r in rows if r[1] == g] for k in (2, 3))
            grams = lambda t, k: Counter(tuple(t[i : i + k]) for i in range(len(t) - k + 1))
            want = [sum((grams(p, k) & grams(r, k)).total() for p, r in zip(ps, rs, strict=True)) for k in range(1, 5)]
            assert got[g].matches == want and got[g].pairs == len(ps)
            assert (got[g].translation_length, got[g].reference_length) == (sum(map(len, ps)), sum(map(len, rs)))
            assert got[g].possible == [sum(max(0, len(p) - k + 1) for p in ps) for k in range(1, 5)]


def test_clipped_matches_by_order_merge_repeated_ids(spark):
    rng = random.Random(4)
    rows = [(i if i < 30 else rng.choice([1, 2, None]), " ".join(rng.choices("abc", k=rng.randint(0, 8))), " ".join(rng.choices("abc", k=6))) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, pred string, ref string")
    grams = lambda t, k: Counter(tuple(t[i : i + k]) for i in range(len(t) - k + 1))
    want = {}
    for k in range(1, 5):
        ps, rs = {}, {}
        for i, p, r in rows:
            ps[i], rs[i] = ps.get(i, Counter()) + grams(p.split(), k), rs.get(i, Counter()) + grams(r.split(), k)
        want[k] = (sum((ps[i] & rs[i]).total() for i in ps), sum(c.total() for c in ps.values()), sum(len(ps[i] & rs[i]) for i in ps))
    got = B.clipped_by_order(df, tokenizer="whitespace")
    assert {r.n: (r.matches, r.possible, r.shared_grams) for r in got.collect()} == want
    # ids of one row move no grams: with only such ids every order still comes out
    one = B.clipped_by_order(df.where("id > 2 and id < 30"), tokenizer="whitespace").collect()
    assert len(one) == 4
    assert B.clipped_by_order(df.where("id > 99"), tokenizer="whitespace").count() == 0
    assert [r.n for r in B.clipped_by_order(df.selectExpr("id", "'' AS pred", "'x y' AS ref").where("id = 5"), tokenizer="whitespace").orderBy("n").collect()] == [1, 2]


def test_reference_union_holds_a_bounded_share_of_the_text(spark):
    from textscore.operators.partitioning import partitions_by_text

    rows = [(i % 3 if i % 4 else None, i // 6, "a b a " * (i % 3) + "c") for i in range(24)]
    refs = spark.createDataFrame(rows, "id long, _ref_no long, ref string")
    assert partitions_by_text(refs, "ref", per_partition=10) == -(-sum(len(r[2]) for r in rows) // 10) > partitions_by_text(refs, "ref")
    counts, want = {}, {}
    for i, no, text in rows:  # rows of one id and number are one reference
        t = text.split()
        for k in range(1, 5):
            for g in zip(*(t[j:] for j in range(k))):
                counts[i, no, k, " ".join(g)] = counts.get((i, no, k, " ".join(g)), 0) + 1
    for (i, _, k, g), c in counts.items():
        want[i, k, g] = max(c, want.get((i, k, g), 0))
    got = B.reference_union(refs, tokenizer="whitespace", num_partitions=11)
    assert {(r.id, r.n, r.gram): r.c for r in got.collect()} == want
    assert got.rdd.getNumPartitions() == 11
