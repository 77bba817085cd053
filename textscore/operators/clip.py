"""Clipped n-gram matches of two token arrays of one row.

A row holds both segments, so its n-grams meet without an exchange: a batch's tokens
get numbers, an n-gram is the number of its first n - 1 tokens (which knows its row)
and its last token, and the counts of both sides are compared gram by gram.  Rows are
taken in blocks of about ``BLOCK`` tokens; nothing but a few sums leaves a block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BLOCK = 100_000  # tokens compared at a time inside a task; their tables fit a core's cache


def count_columns(max_order: int) -> list[str]:
    """``_tl``, ``_rl`` (lengths) and, per order, clipped matches, n-grams of the first
    side and distinct n-grams that both sides have."""
    return ["_tl", "_rl", *(f"_{c}{k}" for k in range(1, max_order + 1) for c in ("clip", "pc", "shared"))]


def _numbers(values) -> np.ndarray:
    """Equal values get equal numbers (from 0, no gaps; a null is a value too)."""
    return pc.dictionary_encode(values, null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _side(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all rows, and how many each row has (a null array: none)."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten(), sizes


def _block_counts(first: pa.Array, second: pa.Array, max_order: int) -> list[np.ndarray]:
    (a, a_sizes), (b, b_sizes) = _side(first), _side(second)
    n = len(a_sizes)
    token = _numbers(pa.concat_arrays([a, b]))
    left = np.concatenate((a_sizes, b_sizes))  # tokens of each segment, first sides before second ones
    seg = np.repeat(np.arange(2 * n), left)
    rest = np.repeat(np.cumsum(left), left) - np.arange(len(token))  # tokens from here to the segment's end
    out = [a_sizes, b_sizes]
    words = int(token.max()) + 1 if len(token) else 1
    at, gram = np.arange(len(token)), seg % n if n else seg
    for k in range(1, max_order + 1):
        whole = rest[at] >= k
        at = at[whole]
        gram = _numbers(pa.array(gram[whole] * words + token[at + k - 1]))
        found = int(gram.max()) + 1 if len(gram) else 0
        is_first = seg[at] < n
        pcount, rcount = np.bincount(gram[is_first], minlength=found), np.bincount(gram[~is_first], minlength=found)
        row = np.zeros(found, np.int64)
        row[gram] = seg[at] % n if n else 0
        clip = np.minimum(pcount, rcount)
        sums = [np.bincount(row, weights=w, minlength=n).astype(np.int64) for w in (clip, pcount, clip > 0)]
        out.extend(sums)
    return out


def _blocks(tokens: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``BLOCK`` tokens each; a longer row is a block of its own."""
    start, held = 0, 0
    for i, t in enumerate(tokens.tolist()):
        if i > start and held + t > BLOCK:
            yield start, i
            start, held = i, 0
        held += t
    if len(tokens) > start:
        yield start, len(tokens)


def pair_counts(rows: DataFrame, keys: Sequence[str], first: str, second: str, max_order: int) -> DataFrame:
    """``keys`` and ``count_columns`` of every row, from its token arrays ``first`` and ``second``."""
    names = [*keys, *count_columns(max_order)]
    counts = [T.StructField(c, T.LongType()) for c in names[len(keys) :]]

    def run(batches):
        for batch in batches:
            held, (a, b) = batch.columns[: len(keys)], batch.columns[len(keys) :]
            tokens = sum(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
            for start, end in _blocks(tokens):
                found = _block_counts(a.slice(start, end - start), b.slice(start, end - start), max_order)
                arrays = [*(c.slice(start, end - start) for c in held), *(pa.array(c, pa.int64()) for c in found)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kept = rows.select(*keys, first, second)
    return kept.mapInArrow(run, T.StructType([*(rows.schema[k] for k in keys), *counts]))
