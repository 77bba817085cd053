"""Column functions for fixed-length id sequences (E3, E4, E7, A9 per position)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def effective_block_size(block_size: int, model_max: int, cap: bool = True) -> int:
    """Block size <= 0 means the model maximum; with ``cap`` it never exceeds it."""
    size = model_max if block_size <= 0 else block_size
    return min(size, model_max) if cap else size


def specials_in_block(bos_id: int | None, eos_id: int | None) -> int:
    """Places of a block that the start and end id take."""
    return (bos_id is not None) + (eos_id is not None)


def truncate_pad(ids: Column | str, block_size: int, pad_id: Column | int, eos_id: int | None = None, bos_id: int | None = None) -> Column:
    """Cut to ``block_size`` and right-pad with ``pad_id`` to exactly that length.

    With ``bos_id`` and ``eos_id`` the body is cut to what they leave of the block, and
    the start and end id stand around it, also around an empty body.
    """
    c = _col(ids)
    pad = pad_id if isinstance(pad_id, Column) else F.lit(pad_id)
    taken = specials_in_block(bos_id, eos_id)
    if taken:
        around = [F.array(F.lit(i)) if i is not None else None for i in (bos_id, eos_id)]
        parts = [around[0], F.slice(c, 1, max(0, block_size - taken)), around[1]]
        c = F.concat(*(p for p in parts if p is not None))
    body = F.slice(c, 1, block_size)
    missing = F.greatest(F.lit(block_size) - F.size(body), F.lit(0))
    return F.concat(body, F.array_repeat(pad.cast("int"), missing))


def attention_mask(ids: Column | str, block_size: int, eos_id: int | None = None, bos_id: int | None = None) -> Column:
    """1 for every real position of the truncated sequence, 0 for padding."""
    c = _col(ids)
    n = F.least(F.size(c) + specials_in_block(bos_id, eos_id), F.lit(block_size))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(block_size) - n))


def pad_to(ids: Column | str, length: Column | int, pad_id: int) -> Column:
    """Right-pad to a given (e.g. per-batch maximum) length."""
    c = _col(ids)
    target = length if isinstance(length, Column) else F.lit(length)
    return F.concat(c, F.array_repeat(F.lit(pad_id), F.greatest(target - F.size(c), F.lit(0))))


def argmax(values: Column | str) -> Column:
    """Index (0-based) of the largest value; the lowest index on ties."""
    c = _col(values)
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def log_softmax_at(logits: Column | str, target: Column | str) -> Column:
    """Negative log-likelihood of ``target`` under softmax(logits), max-shifted.

    A target outside the logits fails the job; a null one gives null.
    """
    lg = F.transform(_col(logits), lambda x: x.cast("double"))
    m = F.array_max(lg)
    lse = m + F.ln(F.aggregate(lg, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))
    t = _col(target)
    outside = (t < 0) | (t >= F.size(lg))
    return F.when(outside, F.raise_error(F.lit("target outside the logits")).cast("double")).otherwise(lse - F.get(lg, t))
