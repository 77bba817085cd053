"""Best-fit packing of documents into sequences of several permitted lengths.

Items go longest first into the open bin they fill best.  Where none has room,
a new bin is opened in the length that costs least for each token that can
still fill it (a length beyond what is left to pack pays for empty room), so the
permitted lengths are weighed against each other at every opening.  When all is
placed, each bin shrinks to the cheapest length that holds its contents.

Documents are packed in windows of a task's input (``WINDOW`` pieces at a time),
so there is no shuffle, no hot group and bounded memory; a document longer than
the longest length is cut into pieces.  Bin numbers hold the task's partition
and are the same whenever the same splits are read.

Defined results: a document without tokens (or with a null count) gets one row
with null bin columns; rows that repeat are packed one by one; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textscore.llm.encoding import encoder, shared_tokenizer

WINDOW = 50_000  # pieces packed together
LENGTHS = (512, 1024, 2048, 4096, 8192)


def sequence_cost(length: int) -> float:
    """Tokens computed for one sequence, and a fixed share for each sequence."""
    return length + 32.0


def pack(sizes: Sequence[int], lengths: Sequence[int], cost: Callable[[int], float]) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of every item (1 to ``max(lengths)`` long), and each bin's final length."""
    lengths = sorted(lengths)
    costs = {c: cost(c) for c in lengths}
    left = sum(sizes)
    by_room: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]  # open bins by the room they have
    rooms = 0  # bit r is set where a bin has room r
    bins, offsets, opened, filled = [0] * len(sizes), [0] * len(sizes), [], []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room = min((c for c in lengths if c >= size), key=lambda c: (costs[c] / min(c, left), -c))
            b = len(opened)
            opened.append(room)
            filled.append(0)
        bins[item], offsets[item] = b, filled[b]
        filled[b] += size
        left -= size
        if room > size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    final = [min((c for c in lengths if c >= n), key=lambda c: (costs[c], c)) for n in filled]
    return bins, offsets, final


def _packed(rows: DataFrame, sizes: Callable[[], Callable[[pa.Array], Iterator[int | None]]], lengths: Sequence[int], cost: Callable[[int], float], window: int) -> DataFrame:
    """Pieces of the rows ``(id, x)``; ``sizes()`` gives the tokens of a batch of ``x``."""
    longest = max(lengths)

    def run(batches):
        bin_base, pieces, tokens_of = TaskContext.get().partitionId() << 36, [], sizes()

        def flush():
            nonlocal bin_base
            held = [p for p in pieces if p[3]]
            bins, offsets, final = pack([p[3] for p in held], lengths, cost)
            rows = [(*p, bin_base + b, o, final[b]) for p, b, o in zip(held, bins, offsets, strict=True)]
            rows += [(*p, None, None, None) for p in pieces if not p[3]]
            bin_base += len(final)
            pieces.clear()
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
            names = ["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_offset", "bin_length"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for doc, size in zip(batch.column(0).to_pylist(), tokens_of(batch.column(1)), strict=True):
                starts = range(0, size or 1, longest)
                for k, start in enumerate(starts):
                    pieces.append((doc, k, start, min(longest, (size or 0) - start)))
                    if len(pieces) >= window:
                        yield flush()
        if pieces:
            yield flush()

    return rows.mapInArrow(run, "doc_id long, piece int, start long, n_tokens int, bin_id long, bin_offset int, bin_length int")


def pack_documents(
    docs: DataFrame, size_col: str = "n_tokens", id_col: str = "doc_id", lengths: Sequence[int] = LENGTHS,
    cost: Callable[[int], float] = sequence_cost, window: int = WINDOW,
) -> DataFrame:
    """One row for each piece: ``(doc_id, piece, start, n_tokens, bin_id, bin_offset, bin_length)``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.col(size_col), F.lit(0)).cast("long").alias("size"))
    return _packed(rows, lambda: lambda x: iter(x.to_pylist()), lengths, cost, window)


def pack_texts(
    docs: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id", lengths: Sequence[int] = LENGTHS,
    cost: Callable[[int], float] = sequence_cost, window: int = WINDOW,
) -> DataFrame:
    """``pack_documents`` by the texts' own token counts: a task counts and packs in one
    pass and hands back pieces only (a null text is empty)."""
    shared = shared_tokenizer(docs.sparkSession, tokenizer_path)

    def sizes():
        own = encoder(shared.value)
        return lambda texts: (own.count(t.as_py() or "") for t in texts)

    return _packed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), sizes, lengths, cost, window)
