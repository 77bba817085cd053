"""Registered queries of the operators in this package."""

from __future__ import annotations

from pyspark.sql import functions as F

from textscore.llm import ann, concat_cut, decontamination, langid, merkle, packing, pii, prefix_trie, quality, simhash, token_counts, toxicity, url_filter
from textscore.session import table_path

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def read(spark, sf_dir: str, name: str):
    return spark.read.parquet(table_path(sf_dir, name))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Stands in for the secret a deployment would pass.
PII_KEY = "registered-query-key"


@query
def op1_pii_surrogates(spark, sf_dir):
    return pii.replace_entities(read(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


@query
def op2_quality_co_training(spark, sf_dir):
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op3_token_counts(spark, sf_dir):
    return token_counts.count_documents(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), limit=2048)


@query
def op4_best_fit_packing(spark, sf_dir):
    return packing.pack_texts(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op5_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle_words=3, max_bits=2)


URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


@query
def op6_url_filter(spark, sf_dir):
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES)


@query
def op7_language_id(spark, sf_dir):
    return langid.identify(read(spark, sf_dir, "documents"), folds=4, held_out_fold=2)


@query
def op8_benchmark_decontamination(spark, sf_dir):
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op9_nearest_neighbours(spark, sf_dir):
    return ann.search(read(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


@query
def op10_toxicity(spark, sf_dir):
    return toxicity.detect(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), folds=5, held_out_fold=0)


@query
def op11_concatenate_and_cut(spark, sf_dir):
    path = tokenizer_path("word_bpe_49k.json")
    return concat_cut.pieces(concat_cut.concatenate_and_cut(read(spark, sf_dir, "documents"), path, length=2048, end_id=1))


@query
def op12_merkle_manifest(spark, sf_dir):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    named = [F.col(c) for c in fields]
    # what a later reader finds: some documents have lost their line ends
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", merkle.leaf_hash(*named).alias("leaf"), merkle.leaf_hash(*named[:-1], text).alias("found"))
    manifest = merkle.build(docs, "source", "doc_id", "leaf", keep=["found"])
    proven = merkle.prove(manifest, "leaf", "found", "doc_id").withColumnRenamed("id", "doc_id")
    return proven.drop("proof")


@query
def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(
        read(spark, sf_dir, "conversations"),
        base_of=lambda c: c - c % 100,
        head_of=lambda c: F.crc32(c.cast("string").cast("binary")) % 6,
        longest_head=5,
    )
