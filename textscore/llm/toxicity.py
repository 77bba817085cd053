"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of hashed words, word pairs and pairs that skip one or
two words.  Features of a bounded sample of labelled documents are built by many
tasks; FTRL-proximal (per-coordinate rates, L1 and L2) then goes over that
sample in one.  L1 leaves few weights, which are broadcast as (bucket, weight)
pairs to score whole texts.

Defined results: null and empty texts are scored by the bias alone; labels that
are null or have no document teach nothing; a doc_id with several labels counts
as toxic if one says so; a repeated doc_id teaches once; without labels of both
kinds every score is the share of label 1 (0 without any).
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textscore.llm.common import crc_mod, with_batch_columns, written

BITS = 18
MAX_CACHED = 300_000
BLOCK = 1 << 17  # words whose features are built at a time
WORD = re.compile(r"\w+")


class Features:
    """Hashed features of texts; lives in a task and caches the hashes of words."""

    def __init__(self) -> None:
        self.hashes: dict[str, int] = {}

    def _word(self, word: str) -> int:
        if len(self.hashes) > MAX_CACHED:
            self.hashes.clear()
        h = self.hashes[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h

    def blocks(self, text: str | None):
        """Buckets of a text's features, repeats included, in blocks of bounded size."""
        words, known = WORD.findall((text or "").lower()), self.hashes
        for start in range(0, len(words), BLOCK):
            part = words[start : start + BLOCK + 3]
            h = np.array([known.get(w) or self._word(w) for w in part], np.uint64)
            mixed = [h[:BLOCK] * np.uint64(0x9E3779B97F4A7C15)]
            for gap in (1, 2, 3):  # neighbours, and pairs that skip one or two words
                pairs = h[:-gap] * np.uint64(0x100000001B3) + h[gap:] + np.uint64(gap)
                mixed.append(pairs[:BLOCK] * np.uint64(0xC2B2AE3D27D4EB4F))
            yield (np.concatenate(mixed) >> np.uint64(64 - BITS)).astype(np.int64)

    def unique(self, text: str | None) -> np.ndarray:
        found = [np.unique(b) for b in self.blocks(text)]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights after FTRL-proximal over the rows; the last entry is the bias."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(zi, ni, penalty):
        return np.where(np.abs(zi) <= penalty, 0.0, -(zi - np.sign(zi) * penalty) / ((beta + np.sqrt(ni)) / alpha + l2))

    penalty = np.full(size, l1)
    penalty[-1] = 0.0
    for _ in range(epochs):
        for at, y in rows:
            at = np.append(at, size - 1)
            w = weights(z[at], n[at], penalty[at])
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum())))) - y
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    return weights(z, n, penalty)


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_train_docs: int = 16_000,
    epochs: int = 4, alpha: float = 4.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.01,
) -> dict:
    """Fit on at most ``max_train_docs`` labelled documents (those whose ids hash lowest)."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_docs)
    # at most max_train_docs ids and labels are broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(written(chosen, "toxic-labels")), "doc_id")

    def make():
        f = Features()
        return lambda texts: [[f.unique(t) for t in texts]]

    rows = with_batch_columns(rows, ["text"], make, {"at": ("array<bigint>", pa.list_(pa.int64()))})
    rows = rows.select("doc_id", "y", "at").dropDuplicates(["doc_id"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        data = list(zip(map(np.asarray, pdf["at"]), map(int, pdf["y"]), strict=True))
        w = ftrl([data[i] for i in np.random.default_rng(5).permutation(len(data))], epochs, alpha, beta, l1, l2)
        kept = np.flatnonzero(w)
        # two further rows: the documents seen, and those of label 1
        return pd.DataFrame({"bucket": np.append(kept, [-1, -2]), "w": np.append(w[kept], [len(pdf), pdf["y"].sum()])})

    # the one group holds max_train_docs rows at most; one row for each bucket comes back
    fitted = rows.withColumn("sample", F.lit("all")).groupBy("sample").applyInPandas(fit, "bucket bigint, w double").toPandas()
    w = dict(zip(fitted.bucket, fitted.w, strict=True))
    seen, toxic, bias = w.pop(-1, 0.0), w.pop(-2, 0.0), w.pop(1 << BITS, 0.0)
    share = toxic / seen if seen else 0.0
    if not 0 < share < 1:
        return {"at": np.zeros(0, np.int64), "w": np.zeros(0), "bias": None, "share": share}
    return {"at": np.array(list(w), np.int64), "w": np.array(list(w.values()), float), "bias": bias, "share": share}


def score(docs: DataFrame, model: dict, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` plus the probability of label 1; the model has 2**BITS weights at most."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m, f = shared.value, Features()
        if m["bias"] is None:
            return lambda texts: [[m["share"]] * len(texts)]
        table = np.zeros(1 << BITS)
        table[m["at"]] = m["w"]
        holds = table != 0

        def one(text):
            hits = [b[holds[b]] for b in f.blocks(text)]
            x = m["bias"] + (table[np.unique(np.concatenate(hits))].sum() if hits else 0.0)
            return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))

        return lambda texts: [[one(t) for t in texts]]

    return with_batch_columns(docs, [text_col], make, {out_col: ("double", pa.float64())})


def detect(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0, **fit) -> DataFrame:
    """Every row's ``(doc_id, held_out, score, predicted)``; learns from the other folds only."""
    held = lambda: F.coalesce(crc_mod("doc_id", folds) == held_out_fold, F.lit(False))
    model = train(docs, labels.where(~held()), **fit)
    rows = score(docs.select("doc_id", held().alias("held_out"), "text"), model)
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
