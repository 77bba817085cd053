"""Concatenate and cut: all documents in one stream of tokens, cut into windows.

First pass: every task encodes its documents and stores their ids with the place
of each in the task's own stream.  The tasks' token totals are prefix-summed in
two passes (within groups of tasks, then over the groups), which gives every task
its place in the one stream of the whole corpus.  Second pass: each run of rows is
cut at the windows' fixed places.  A window that lies within a run is complete at
once; where a run begins or ends inside a window, the task hands on a *boundary
record* (the window's part that it holds), and the records of one window are joined.
Nothing but boundary records is shuffled.

The stream leaves no room between documents, so all windows are full but for the
end of the stream, whose tokens are cut into sequences of descending powers of two
and so need no padding either.

Defined results: a null text is empty and still holds the end id; rows that repeat,
and rows with a null id, are packed one by one; the text is encoded whole, in bounded
blocks; a document's ids are stored in parts of at most ``CHUNK``; columns other than
the id and the text play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textscore.llm.encoding import encoder, shared_tokenizer
from textscore.session import scratch_path

CHUNK = 1 << 18  # ids in one stored row
FLUSH = 16 << 20  # bytes of ids in one Arrow batch
TASKS_IN_GROUP = 1024
MAX_BROADCAST_TASKS = 1 << 18  # offsets of so many tasks (24 bytes each) are broadcast, more are joined by shuffle

STREAM = "task long, at long, doc_id long, start long, n int, doc_tokens long, ids binary"
SPAN = "struct<doc_id:long, start:long, length:long, doc_tokens:long, offset:long>"


def token_stream(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass, stored: the ids of every document and their place in the task's stream."""
    spark = docs.sparkSession
    shared = shared_tokenizer(spark, tokenizer_path)
    schema = pa.schema([(n, t) for n, t in zip(
        ("task", "at", "doc_id", "start", "n", "doc_tokens", "ids"),
        (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)])
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, at, rows, held = encoder(shared.value), TaskContext.get().partitionId(), 0, [], 0

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            rows.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = own.ids(text.as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, CHUNK):
                    part = ids[4 * start : 4 * (start + CHUNK)]
                    rows.append((task, at, doc, start, len(part) // 4, total, part))
                    at += len(part) // 4
                    held += len(part)
                    if held > FLUSH:
                        yield flush()
                        held = 0
        if rows:
            yield flush()

    path = scratch_path(spark, "token-stream")
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    rows.mapInArrow(run, STREAM).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(STREAM).parquet(path)


def stream_offsets(stream: DataFrame) -> DataFrame:
    """Where each task's stream begins in the whole, and how long the whole is.

    One row a task.  Prefix sums in two passes: inside groups of tasks, and over
    the groups' totals, so that no window covers more than a thousandth of the tasks.
    """
    totals = stream.groupBy("task").agg(F.sum("n").alias("tokens")).withColumn("group", F.expr(f"task div {TASKS_IN_GROUP}"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    inside = totals.withColumn("inside", F.coalesce(F.sum("tokens").over(Window.partitionBy("group").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    groups = totals.groupBy("group").agg(F.sum("tokens").alias("tokens"))
    groups = groups.select(
        "group",
        F.coalesce(F.sum("tokens").over(before.orderBy("group")), F.lit(0)).alias("earlier"),
        F.sum("tokens").over(before.orderBy("group").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    return inside.join(groups, "group").select("task", (F.col("earlier") + F.col("inside")).alias("base"), "total")


def place(position: int, total: int, length: int) -> tuple[int, int, int]:
    """The sequence that holds a place of the stream, the offset there, and the
    sequence's length.  The last ``total % length`` tokens lie in descending powers of two."""
    full = total // length
    if position < full * length:
        return position // length, position % length, length
    rest, at = total % length, position - full * length
    sequence, start = full, 0
    while True:
        size = 1 << (rest - start).bit_length() - 1
        if at < start + size:
            return sequence, at - start, size
        sequence, start = sequence + 1, start + size


def cut(placed: DataFrame, length: int) -> DataFrame:
    """Second pass over rows with ``base`` and ``total``: complete windows, and
    boundary records (``whole`` is false) of those that reach beyond a run of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        sequence, begin, size, ids, spans, next_at = None, 0, 0, [], [], None

        def close():
            nonlocal held
            filled = sum(map(len, ids)) // 4
            if filled:
                data = b"".join(ids)
                rows.append((sequence, begin, data, list(spans), filled == size))
                held += len(data)
            ids.clear()
            spans.clear()

        def flush():
            nonlocal held
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "offset")])), pa.bool_())
            held, columns = 0, zip(*rows, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["sequence_id", "begin", "ids", "spans", "whole"])
            rows.clear()
            return out

        for batch in batches:
            names = ("at", "doc_id", "start", "n", "doc_tokens", "base", "total")
            columns = [batch.column(n).to_pylist() for n in names]
            for at, doc, start, n, doc_tokens, base, total, data in zip(*columns, batch.column("ids"), strict=True):
                data, position = data.as_py(), base + at
                if position != next_at:  # another run of rows begins
                    close()
                    sequence = None
                done = 0
                while done < n:
                    s, offset, room = place(position + done, total, length)
                    if s != sequence:
                        close()
                        sequence, begin, size = s, offset, room
                    take = min(n - done, room - offset)
                    ids.append(data[4 * done : 4 * (done + take)])
                    spans.append({"doc_id": doc, "start": start + done, "length": take, "doc_tokens": doc_tokens, "offset": offset})
                    done += take
                next_at = position + n
                if held > FLUSH:
                    yield flush()
        close()
        if rows:
            yield flush()

    return placed.mapInArrow(run, f"sequence_id long, begin long, ids binary, spans array<{SPAN}>, whole boolean")


def concatenate_and_cut(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stream's windows: ``(sequence_id, begin, ids, spans, whole)``.

    ``ids`` are little-endian unsigned 32-bit numbers, ``spans`` say which part of
    which document lies at which offset of the sequence.  A row is a sequence
    (``whole``) or a boundary record: the part of one from offset ``begin`` on.
    Sequence ids count from 0 without gaps.
    """
    stream = token_stream(docs, tokenizer_path, end_id, id_col, text_col)
    offsets = stream_offsets(stream)
    if offsets.count() <= MAX_BROADCAST_TASKS:
        placed = stream.join(F.broadcast(offsets), "task")
    else:  # the shuffle mixes the rows of a task, so they are put in order again
        placed = stream.join(offsets, "task").sortWithinPartitions("task", "at")
    return cut(placed, length)


def sequences(windows: DataFrame) -> DataFrame:
    """One row for each sequence, boundary records joined: ``(sequence_id, n_tokens, ids, spans)``."""
    records = windows.where("not whole").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("begin", "ids", "spans"))).alias("parts"))
    joined = records.select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"),
        F.flatten(F.transform("parts", lambda p: p["spans"])).alias("spans"),
    )
    whole = windows.where("whole").select("sequence_id", "ids", "spans").unionByName(joined)
    return whole.select("sequence_id", F.expr("cast(octet_length(ids) div 4 as int)").alias("n_tokens"), "ids", "spans")


def pieces(windows: DataFrame) -> DataFrame:
    """One row for each document's part in each sequence, with the CRC-32 of its ids.

    A boundary record holds its documents' parts whole, so this needs no join.
    """
    digest = F.transform("spans", lambda s: F.struct(
        s["doc_id"].alias("doc_id"), s["start"].alias("start"), s["length"].alias("length"),
        F.crc32(F.substring(F.col("ids"), ((s["offset"] - F.col("begin")) * 4 + 1).cast("int"), (s["length"] * 4).cast("int"))).alias("ids_crc32"),
        s["doc_tokens"].alias("doc_tokens"), s["offset"].alias("offset")))
    return windows.select("sequence_id", F.inline(digest)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
