"""Quality classifier by co-training of a text view and a metadata view.

The text view holds measures of a text's make-up (shares of letters, digits and
symbols, repeated words and lines, entropy) and which words it has, hashed to
2**16 places; the metadata view holds language, source and size.  The
``OWN_VALUES`` most frequent values of a metadata column, counted over all
documents, have a place of their own, the rest share 2**12 places by hash.  Each
view has its own logistic regression on sparse vectors.  In every round each
classifier labels the unlabelled documents it is sure of for the other one.  A
fold of the labelled documents, which no classifier has seen, calibrates both
views; all documents are scored by their combination.

All documents and labels take part; features are computed once and kept as a
narrow table, so later rounds never read a text.

Defined results: a null or empty text has no text features; null metadata are
values of their own; a null size has no size class, and sizes from 2**38 share
the last one; a doc_id with several labels counts as bad if one says so; labels
without a document teach nothing; with labels of one kind only, every score is 1
or 0 like them, without labels 0.5; where the labels outside the calibration fold
are of one kind, none are held back; a null doc_id has no label; repeated rows
are scored alike, one row each; an empty table gives no rows; other columns are
not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textscore.llm.common import hash_unit, map_batches
from textscore.session import scratch_path

MEASURES = 19
WORD_PLACES = 1 << 16
OWN_VALUES = 1024  # of each metadata column; their hashes are sent to every task
VALUE_PLACES = 1 << 12  # of the other values of a metadata column
SIZE_CLASSES = 20
PENALTY, ITERATIONS, TOLERANCE = 1e-4, 20, 1e-5
LINES = re.compile(r"[\r\n]+")
SURE = 0.95  # probability from which a document is passed to the other view
PSEUDO_WEIGHT = 0.3  # of a passed document, beside 1 for a labelled one
CALIBRATION_SHARE = 0.2


def _kinds() -> np.ndarray:
    """Class of each byte: letter, capital, digit, white space, mark, symbol, not ASCII."""
    out = np.full(256, 5)
    for b in range(256):
        c = chr(b)
        out[b] = 6 if b > 127 else 1 if c.isupper() else 0 if c.isalpha() else 2 if c.isdigit() else 3 if c.isspace() else 4 if c in ".,;:'\"()-?" else 5
    return out


class TextView:
    """Places and values of a text's features; lives in a task."""

    SIZE = MEASURES + WORD_PLACES

    def __init__(self) -> None:
        self.kinds = _kinds()

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.int32), np.zeros(0)
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        bytes_of = np.bincount(raw, minlength=256)
        kinds = np.bincount(self.kinds, bytes_of, 7) / len(raw)
        shares = bytes_of[bytes_of > 0] / len(raw)
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        lines = [x for x in LINES.split(text) if x.strip()]
        distinct_lines = set(lines)
        line_chars = sum(map(len, lines))
        lens = np.fromiter(map(len, words), np.int64, len(words))
        measures = [
            np.log1p(len(raw)) / 10, *kinds, -(shares * np.log(shares)).sum() / 5, lens.mean() / 10, min(lens.max(), 200) / 50,
            len(counts) / len(words), max(counts.values()) / len(words), 1 - len(distinct_lines) / len(lines),
            1 - sum(map(len, distinct_lines)) / line_chars, np.log1p(len(lines)) / 5, min(line_chars / len(lines), 1000) / 1000,
            sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines), sum(not w[-1].isalnum() for w in counts) / len(counts),
        ]
        places = np.array(sorted({zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORD_PLACES for w in counts}), np.int32)
        values = np.concatenate((np.round(measures, 4), np.full(len(places), len(places) ** -0.5)))
        return np.concatenate((np.arange(MEASURES, dtype=np.int32), MEASURES + places)), values


VECTOR_SQL = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def _vectors(found: Sequence[tuple[np.ndarray, np.ndarray]], size: int) -> pa.StructArray:
    """Sparse vectors as a column, laid out as Spark stores them."""
    ends = np.cumsum([0, *(len(at) for at, _ in found)]).astype(np.int32)
    at, values = (np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in (0, 1))
    parts = [
        pa.array(np.zeros(len(found), np.int8)), pa.array(np.full(len(found), size, np.int32)),
        pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(values.astype(float))),
    ]
    return pa.StructArray.from_arrays(parts, names=["type", "size", "indices", "values"])


def _key(name: str) -> Column:
    """A metadata value (null is one too) as a number."""
    return F.xxhash64(F.col(name).isNull(), F.col(name).cast("string"))


def own_places(docs: DataFrame, name: str) -> dict[int, int]:
    """The most frequent values of a column and their places, ``OWN_VALUES`` at most."""
    top = docs.groupBy(_key(name).alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(OWN_VALUES)
    return {r["key"]: i for i, r in enumerate(top.collect())}


def page_places(keys: Sequence[int], size: int | None, own: Sequence[dict[int, int]]) -> list[int]:
    """Places of one document's metadata, ascending."""
    width = OWN_VALUES + VALUE_PLACES
    out = [i * width + (o[k] if k in o else OWN_VALUES + k % VALUE_PLACES) for i, (k, o) in enumerate(zip(keys, own, strict=True))]
    return out if size is None else [*out, len(own) * width + size]


def features(docs: DataFrame, labels: DataFrame, label_col: str, metadata: list[str], size_col: str | None) -> DataFrame:
    """``(doc_id, text_view, page_view, y)``, one row per input row, written; ``y`` is null where unlabelled."""
    own = [own_places(docs, c) for c in metadata]
    page_size = len(own) * (OWN_VALUES + VALUE_PLACES) + SIZE_CLASSES
    size = F.lit(None)
    if size_col:
        size = F.least(F.floor(F.log2(F.greatest(F.col(size_col).cast("double"), F.lit(0.0)) + 1) / 2), F.lit(SIZE_CLASSES - 1))
        size = F.when(F.col(size_col).isNotNull(), size)

    def make():
        view = TextView()

        def step(batch):
            texts = _vectors([view.of(t) for t in batch.column("text").to_pylist()], TextView.SIZE)
            rows = zip(batch.column("keys").to_pylist(), batch.column("size").to_pylist(), strict=True)
            pages = [page_places(k, s, own) for k, s in rows]
            pages = _vectors([(np.array(p, np.int32), np.ones(len(p))) for p in pages], page_size)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), texts, pages], names=["doc_id", "text_view", "page_view"])

        return step

    keys = F.array(*[_key(c) for c in metadata]).cast("array<bigint>")
    rows = docs.select("doc_id", "text", keys.alias("keys"), size.cast("int").alias("size"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_batches(rows, make, f"doc_id {kind}, text_view {VECTOR_SQL}, page_view {VECTOR_SQL}")
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label_col).cast("double").alias("y"))
    path = scratch_path(docs.sparkSession, "quality-features")
    rows.join(known, "doc_id", "left").write.parquet(path)
    views = [T.StructField(v, VectorUDT()) for v in ("text_view", "page_view")]
    return docs.sparkSession.read.schema(T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *views, T.StructField("y", T.DoubleType())])).parquet(path)


def _fit(rows: DataFrame, view: str):
    lr = LogisticRegression(featuresCol=view, labelCol="y", weightCol="weight", maxIter=ITERATIONS, regParam=PENALTY, tol=TOLERANCE, standardization=False)
    return lr.fit(rows.select(view, "y", "weight"))


def with_logit(rows: DataFrame, model, view: str, name: str) -> DataFrame:
    """``rows`` with the log-odds of label 1 by a view's classifier."""
    told = model.copy().setFeaturesCol(view).setRawPredictionCol(name).setProbabilityCol("").setPredictionCol("")
    return told.transform(rows).withColumn(name, F.get(vector_to_array(name), F.lit(1)))


def _chance(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def co_train(rows: DataFrame, rounds: int) -> tuple:
    """The text and the metadata classifier after ``rounds`` exchanges."""
    labelled = rows.where("y is not null").withColumn("weight", F.lit(1.0))
    unlabelled = rows.where("y is null")
    text, page = _fit(labelled, "text_view"), _fit(labelled, "page_view")
    for _ in range(rounds):
        told = {}
        for teacher, view in ((text, "text_view"), (page, "page_view")):
            p = _chance(F.col("logit"))
            sure = with_logit(unlabelled, teacher, view, "logit").withColumn("y", F.when(p >= SURE, 1.0).when(p <= 1 - SURE, 0.0))
            sure = sure.where("y is not null").drop("logit")
            told[view] = labelled.unionByName(sure.withColumn("weight", F.lit(PSEUDO_WEIGHT)))
        text, page = _fit(told["page_view"], "text_view"), _fit(told["text_view"], "page_view")
    return text, page


def _calibrated(rows: DataFrame, logit: str) -> Column:
    """Platt scaling of a view's log-odds, fitted on ``rows``."""
    fitted = LogisticRegression(featuresCol="x", labelCol="y", maxIter=25, regParam=1e-3).fit(rows.select(array_to_vector(F.array(logit)).alias("x"), "y"))
    return F.lit(float(fitted.intercept)) + F.col(logit) * float(fitted.coefficients[0])


def score(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", metadata: tuple[str, ...] = ("lang", "source"),
    size_col: str | None = "n_chars", rounds: int = 2,
) -> DataFrame:
    """``(doc_id, p_text, p_page, score, keep)`` for every row of ``docs``; ``score`` is
    the probability of label 1 from both views, ``keep`` whether it is 0.5 or more."""
    rows = features(docs, labels, label_col, list(metadata), size_col)
    held = F.coalesce(hash_unit("doc_id", F.lit("calibration")) < CALIBRATION_SHARE, F.lit(False))
    seen = {r["y"]: r["n"] for r in rows.where(F.col("y").isNotNull()).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum(held.cast("int"))).collect()}
    if len(seen) < 2:
        same = F.lit(float(next(iter(seen), 0.5)))
        return rows.select("doc_id", same.alias("p_text"), same.alias("p_page"), same.alias("score"), (same >= 0.5).alias("keep"))
    fold = rows.where(F.col("y").isNotNull() & held)
    kinds = rows.where("y is not null").agg(F.count_distinct(F.when(held, F.col("y"))), F.count_distinct(F.when(~held, F.col("y")))).first()
    if min(kinds) < 2:  # too few labels to hold any back
        train, fold = rows, rows.where("y is not null")
    else:
        train = rows.where(~(F.col("y").isNotNull() & held))
    text, page = co_train(train, rounds)
    logits = lambda df: with_logit(with_logit(df, text, "text_view", "text_logit"), page, "page_view", "page_logit")
    fold = logits(fold)
    text_told, page_told = _calibrated(fold, "text_logit"), _calibrated(fold, "page_logit")
    share = fold.agg(F.avg("y")).first()[0]
    prior = float(np.log(share / (1 - share)))
    # both views' evidence beyond the share of label 1, which counts once
    both = F.col("text_told") + F.col("page_told") - prior
    out = logits(rows).withColumns({"text_told": text_told, "page_told": page_told})
    return out.select(
        "doc_id", _chance(F.col("text_told")).alias("p_text"), _chance(F.col("page_told")).alias("p_page"), _chance(both).alias("score"), (both >= 0).alias("keep")
    )
