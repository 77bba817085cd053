import __spark_entry__ as E
from conftest import SF0001


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and 0.0 <= rows[0].bleu_score <= 1.0


def test_every_query_has_name_and_oracles_are_subset():
    qs, sql = E.queries(), E.oracle_sql()
    assert len(qs) >= 45 and set(sql) <= set(qs)


def test_queries_run_on_smallest_data(spark):
    qs = E.queries()
    for name in ["a5_bleu_multi", "a9_cross_entropy", "e5_encoded_pairs", "w6_patience", "j1_pairing", "t4_char_bleu_pairs"]:
        df = qs[name](spark, SF0001)
        assert df.count() > 0 and len(df.columns) > 0, name
