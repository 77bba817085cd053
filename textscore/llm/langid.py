"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed 1- to 4-grams (of UTF-8 bytes, lower case) of a
bounded sample of labelled documents; the smoothed log-probability matrix
(languages x buckets) is broadcast and whole texts are scored in numpy.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
ties go to the language that sorts first; with nothing to learn from, every text
is ``und``; rows with a null language or text teach nothing; a null doc_id is
treated as not held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textscore.llm.common import crc_mod, hash_unit, map_batches, with_batch_columns

BUCKETS = 1 << 14  # the hash below keeps 14 bits
LONGEST = 4
BLOCK = 1 << 20  # bytes of a text hashed at a time
MAX_LANGUAGES = 1000
EVIDENCE = 40.0  # n-grams that count in full for the score


# A model is a plain dict, so a broadcast of it needs no class of this package:
# languages (list), log_prob (languages x buckets), log_prior.


def gram_counts(text: str) -> np.ndarray:
    """How many of a text's n-grams fall in each bucket."""
    raw = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(raw), BLOCK):
        # blocks overlap, and each n-gram is counted in the block where it starts
        x = raw[start : start + BLOCK + LONGEST - 1].astype(np.uint32)
        h, found = x, []
        for n in range(1, LONGEST + 1):
            if n > 1:
                h = h[:-1] * np.uint32(257) + x[n - 1 :]
            found.append((h[:BLOCK] + np.uint32(n)) * np.uint32(2654435761) >> np.uint32(18))
            if len(h) < 2:
                break
        counts += np.bincount(np.concatenate(found), minlength=BUCKETS)
    return counts


def train(docs: DataFrame, max_train_docs: int = 50_000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", alpha: float = 0.5, max_languages: int = MAX_LANGUAGES) -> dict:
    """Fit on the labelled rows of ``docs``; of more than about ``max_train_docs``
    a share chosen by a hash of the id, so the fit stays bounded at any scale, and of
    more than ``max_languages`` languages the most frequent."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # the most frequent languages are learned: the matrix is broadcast and must stay bounded
    sizes = known.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    known = known.where(F.col(lang_col).isin([r["lang"] for r in sizes]))
    languages = sorted(r["lang"] for r in sizes)
    share = min(1.0, max_train_docs / max(1, sum(r["count"] for r in sizes)))
    if share < 1:
        known = known.where(hash_unit(F.col(id_col)) < share)
    index = {lang: i for i, lang in enumerate(languages)}

    def make():
        def step(batch):
            counts: dict[int, np.ndarray] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k = index[lang]
                counts[k] = counts[k] + gram_counts(text) if k in counts else gram_counts(text)
            rows = [(np.full(np.count_nonzero(c), k, np.int32), np.flatnonzero(c).astype(np.int32), c[c > 0]) for k, c in counts.items()]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], names=["lang", "bucket", "n"]) if rows else None

        return step

    parts = map_batches(known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), make, "lang int, bucket int, n bigint")
    # at most languages x buckets rows come back
    sums = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((len(languages), BUCKETS), alpha)
    if len(sums):
        table[sums["lang"].to_numpy(), sums["bucket"].to_numpy()] += sums["n"].to_numpy()
    prior = np.array([dict((r["lang"], r["count"]) for r in sizes)[x] for x in languages], float)
    log_prob = np.log(table / table.sum(axis=1, keepdims=True))
    return {"languages": languages, "log_prob": log_prob, "log_prior": np.log(prior / prior.sum()) if len(prior) else prior}


def score_text(text: str | None, model: dict) -> tuple[str, float]:
    """The most likely language and its share of the probability.

    The likelihoods are tempered to those of at most ``EVIDENCE`` n-grams, so the
    score of long texts says how clear the language is, not how long the text is.
    """
    if not text or not model["languages"] or not any(map(str.isalpha, text)):
        return "und", 0.0
    counts = gram_counts(text)
    total = model["log_prob"] @ counts.astype(np.float64)
    best = int(np.argmax(total + model["log_prior"]))
    p = total * min(1.0, EVIDENCE / counts.sum()) + model["log_prior"]
    p = np.exp(p - p.max())
    return model["languages"][best], float(min(1.0, p[best] / p.sum()))


def predict(docs: DataFrame, model: dict, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` plus the language and its score; the matrix (languages x buckets) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def step(texts):
            got = [score_text(t, m) for t in texts]
            return [[g[0] for g in got], [g[1] for g in got]]

        return step

    return with_batch_columns(docs, [text_col], make, {lang_out: ("string", pa.string()), score_out: ("double", pa.float64())}, drop)


def identify(docs: DataFrame, folds: int = 4, held_out_fold: int = 2, max_train_docs: int = 50_000) -> DataFrame:
    """Every row's ``(doc_id, held_out, lang_pred, score)``; learns from the other folds only."""
    held = F.coalesce(crc_mod("doc_id", folds) == held_out_fold, F.lit(False))
    model = train(docs.where(~held), max_train_docs)
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model, drop=("text",)).select("doc_id", "held_out", "lang_pred", "score")
