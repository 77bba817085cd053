"""Approximate nearest neighbours over randomly rotated one-bit codes.

Each vector is scaled to length one, centred and rotated; the signs of its
coordinates are packed into bits and two scalars (the length after centring and
the inner product of the vector with its own code) correct the estimate.  The
estimated inner product of a query with every code comes with an error bound;
only vectors whose upper bound reaches the k-th best found so far are compared
in full, on the original vectors in double precision.

Defined results: vectors that are null, zero, or hold a null or non-finite
component take no part; vectors are compared with those of their own length (a
search for each length that occurs); a repeated query id is asked once, with the smallest of its
vectors; every row with another id is a candidate, repeated rows each on its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textscore.llm.common import empty, map_batches, written
from textscore.session import scratch_path

QUERY_BLOCK = 4096  # queries that are broadcast at a time
ROWS = 512  # codes compared at a time inside a task
PAIRS = 16384  # pairs of vectors compared in full at a time
FOUND = "query_id bigint, vec_id bigint, score double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, vector)`` of the rows that take part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))
    return vectors.where(sound & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))


def rotation(size: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centre(rows: DataFrame, size: int) -> np.ndarray:
    """Mean of the vectors scaled to length one, over all rows."""

    def make():
        def step(batch):
            x = _units(_matrix(batch.column(0)))
            return pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(x.sum(axis=0)), pa.array([len(x)] * size, pa.int64())], names=["i", "s", "n"])

        return step

    sums = map_batches(rows.select("vector"), make, "i int, s double, n bigint").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("m"))
    out = np.zeros(size)
    for r in sums.collect():  # one row for each component
        out[r["i"]] = r["m"]
    return out


def build_index(rows: DataFrame, size: int, middle: np.ndarray, seed: int) -> DataFrame:
    """``(vec_id, vector, code, radius, own)``: packed signs and correction scalars of every row."""
    turn = rotation(size, seed)

    def make():
        def step(batch):
            x = _units(_matrix(batch.column(1))) - middle
            radius = np.sqrt((x * x).sum(axis=1))
            y = x @ turn / np.where(radius > 0, radius, 1)[:, None]
            codes = np.packbits(y > 0, axis=1)
            own = np.where(radius > 0, np.abs(y).sum(axis=1) / math.sqrt(size), 1.0)
            arrays = [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(radius), pa.array(own)]
            return pa.RecordBatch.from_arrays(arrays, names=["vec_id", "vector", "code", "radius", "own"])

        return step

    kind = rows.schema["vector"].dataType.simpleString()
    return map_batches(rows, make, f"vec_id bigint, vector {kind}, code binary, radius double, own double")


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``x`` with the row of ``q`` beside it, in double precision."""
    # scaled by powers of two, which changes no digit and keeps squares finite and above zero
    x, q = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]) for v in (x, q))
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))


def _close(x: np.ndarray, q: np.ndarray, rows: np.ndarray, cols: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that can be among the ``k`` best of their query, by the product
    of the scaled vectors, which is the cosine but for its last digits."""
    product = np.full((len(x), len(q)), -np.inf)
    for i in range(0, len(rows), PAIRS):
        r, c = rows[i : i + PAIRS], cols[i : i + PAIRS]
        product[r, c] = np.einsum("ij,ij->i", x[r], q[c])
    if len(x) >= k:
        floor = np.maximum(floor, np.partition(product, len(x) - k, axis=0)[len(x) - k])
    kept = product[rows, cols] >= floor[cols] - 1e-9
    return rows[kept], cols[kept]


def _search_block(index: DataFrame, ids: np.ndarray, queries: np.ndarray, size: int, middle: np.ndarray, seed: int, k: int, bound: float) -> DataFrame:
    units = _units(queries)
    shared = index.sparkSession.sparkContext.broadcast((ids, queries, units @ rotation(size, seed), units @ middle))

    def run(batches):
        q_ids, q_raw, q_turned, q_middle = shared.value
        n = len(q_ids)
        best, near = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
        q_units = _units(q_raw)
        totals, scale = q_turned.sum(axis=1), 1 / math.sqrt(size)
        for batch in batches:
            vec_ids, raw = np.array(batch.column(0).to_pylist(), np.int64), _matrix(batch.column(1))
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(vec_ids), -1), axis=1, count=size)
            radius, own = np.array(batch.column(3)), np.array(batch.column(4))
            spread = bound * np.sqrt(np.maximum(0, 1 - own * own)) / own / math.sqrt(max(1, size - 1))
            for a in range(0, len(vec_ids), ROWS):
                s = slice(a, a + ROWS)
                product = (2 * (bits[s].astype(np.float64) @ q_turned.T) - totals) * scale / own[s, None]
                upper = q_middle + radius[s, None] * (product + spread[s, None]) + 1e-9
                # against the k-th best of this task, and against the lower bounds of these rows
                lower = q_middle + radius[s, None] * (product - spread[s, None]) - 1e-9
                lower[vec_ids[s, None] == q_ids] = -np.inf
                floor = best[:, -1]
                if len(lower) >= k:
                    floor = np.maximum(floor, np.partition(lower, len(lower) - k, axis=0)[len(lower) - k])
                rows, cols = np.nonzero((upper >= floor) & (vec_ids[s, None] != q_ids))
                if not len(rows):
                    continue
                rows, cols = _close(_units(raw[s]), q_units, rows, cols, best[:, -1], k)
                exact = np.concatenate([cosines(raw[s][rows[i : i + PAIRS]], q_raw[cols[i : i + PAIRS]]) for i in range(0, len(rows), PAIRS)] or [np.empty(0)])
                # merge with what was found before: best first, ties to the smaller id
                c = np.concatenate((cols, np.repeat(np.arange(n), k)))
                v = np.concatenate((vec_ids[s][rows], near.ravel()))
                x = np.concatenate((exact, best.ravel()))
                order = np.lexsort((v, -x, c))
                c, v, x = c[order], v[order], x[order]
                rank = np.arange(len(c)) - np.searchsorted(c, c)
                top = rank < k
                best[c[top], rank[top]], near[c[top], rank[top]] = x[top], v[top]
        i, j = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(near[i, j]), pa.array(best[i, j])], names=["query_id", "vec_id", "score"])

    return index.mapInArrow(run, FOUND)


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7, bound: float = 4.0) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows of each query by cosine.

    ``is_query`` is a condition on ``vec_id``.  The queries are broadcast in blocks
    of about ``QUERY_BLOCK`` rows, each held against all codes and its answers
    written before the next, so neither the plan nor what is broadcast grows with
    the queries; a task returns its own ``k`` best for each query.  ``bound`` is the number of standard errors
    allowed for before a vector is left out.
    """
    rows = usable(vectors, id_col, vector_col)
    sizes = sorted(r[0] for r in rows.select(F.size("vector")).distinct().collect())
    found = empty(vectors.sparkSession, "query_id bigint, rank int, vec_id bigint, score double")
    for size in sizes:
        own = _search_length(rows.where(F.size("vector") == size), size, is_query, k, seed, bound)
        found = own if len(sizes) == 1 else found.unionByName(own)
    return found


def _search_length(rows: DataFrame, size: int, is_query, k: int, seed: int, bound: float) -> DataFrame:
    """``search`` among vectors of one length."""
    spark = rows.sparkSession
    middle = centre(rows, size)
    index = written(build_index(rows, size, middle, seed), "codes")
    asked = index.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = written(asked, "queries")
    blocks = math.ceil(asked.count() / QUERY_BLOCK)
    path = scratch_path(spark, "neighbours")
    empty(spark, FOUND).write.parquet(path)
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        if block:
            ids, raw = np.array([r["vec_id"] for r in block], np.int64), np.array([r["vector"] for r in block], np.float64)
            _search_block(index, ids, raw, size, middle, seed, k, bound).write.mode("append").parquet(path)
    every = spark.read.schema(FOUND).parquet(path)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
