"""The corpus pipeline, stage by stage, against what each stage has to keep."""

import corpus_pipeline
from pyspark.sql import functions as F

from textscore.llm.queries import read

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark, tmp_path):
    docs = read(spark, SF, "documents")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    items = [r.text for r in read(spark, SF, "benchmark").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k == 0:
            assert docs.count() == len(before)  # all are in a known language
        elif k == 1:
            texts = [r.text for r in docs.collect()]
            assert len(set(texts)) == len(texts) == len(set(before.values()))
        elif k == 2:
            left = {r.doc_id: r.text for r in docs.collect()}
            assert not any(b in t for t in left.values() for b in items)
        elif k == 3:
            new = {r.doc_id: r.text for r in docs.collect()}
            assert set(new) == set(left) and not any("+1 (" in t and left[i] == t for i, t in new.items())
            clean = [i for i, t in left.items() if not any(x in t for x in ("@", "+1 (", "token")) and not any(c.isdigit() for c in t)]
            assert clean and all(new[i] == left[i] for i in clean)
    placed = docs.groupBy("bin_id").agg(F.sum("n_tokens").alias("n"), F.max("bin_length").alias("c")).where("bin_id is not null")
    assert {r.doc_id for r in docs.collect()} == set(left) and placed.where("n > c").count() == 0


def test_run_on_edge_rows(spark, tmp_path):
    rows = [(0, None, None, None, None), (1, "", "en", "s", 0), (2, "12 34", "en", "s", 5), (3, "short plain words", "en", "s", 17)]
    rows += [(3, "short plain words", "en", "s", 17)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.piece) for r in got] == [(3, 0)]


def test_extra_columns_pass_through_unchanged(spark, tmp_path):
    docs = read(spark, SF, "documents").where("doc_id < 120")
    names = ["_told", "_score", "_fp", "_held_items", "_k", "_new", "fp", "key", "score", "kept", "n_entities", "surrogate", "Text2"]
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    long = spark.createDataFrame([(10**6, "plain words that go on and on number " * 30_000, "en", "s", 0)], docs.schema[:5])
    docs = docs.unionByName(long.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names}))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = docs.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names)
    assert 10**6 in {r.doc_id for r in rows}
