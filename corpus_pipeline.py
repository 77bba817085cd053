"""From raw documents to packed training sequences, stage by stage.

Each stage applies one operator of ``textscore.llm`` to all that the stage before
kept; its result is written as Parquet and read back as the next one's input.
All stages but the last return the columns of ``documents``.

Defined results: a null or empty text, or one without a letter, has no language and
goes in the first stage; null metadata pass through; of rows that share a doc_id and
are near-duplicates one stays; very long texts are worked on whole; columns beside
those of ``documents`` pass through unchanged, whatever their names; empty tables
give empty results.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textscore.llm import decontamination, langid, packing, pii, simhash
from textscore.llm.common import crc_mod, written
from textscore.llm.queries import PII_KEY, read, tokenizer_path

MIN_LANGUAGE_SCORE = 0.5

#: SQL cannot express the trained language model, nor the later stages.
ORACLE_SQL = None


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def beside_others(stage):
    """``stage`` with other columns under neutral names, so that none clashes with its own."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        hidden = {c: f"kept column {i}" for i, c in enumerate(docs.columns) if c not in COLUMNS}
        out = stage(spark, docs.withColumnsRenamed(hidden), sf_dir)
        return out.withColumnsRenamed({new: old for old, new in hidden.items()})

    return run_stage


@beside_others
def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of MIN_LANGUAGE_SCORE at least."""
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = langid.train(docs.where(~held))
    told = langid.predict(docs, model, lang_out="_told", score_out="_score")
    return told.where((F.col("_told") != "und") & (F.col("_score") >= MIN_LANGUAGE_SCORE)).select(*(f"`{c}`" for c in docs.columns))


@beside_others
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: the smallest doc_id."""
    return simhash.keep_one_per_component(docs, shingle_words=3, max_bits=2)


@beside_others
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


@beside_others
def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with surrogates in the place of personal data."""
    out = pii.replace_entities(docs, PII_KEY, count_col=None)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*(f"`{c}`" for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the packed sequences."""
    return packing.pack_texts(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language ID", keep_identified),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("PII surrogates", replace_personal_data),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = written(out, f"stage-{i}") if i < len(STAGES) - 1 else out
    return docs
