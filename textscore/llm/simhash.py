"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments.  Two fingerprints that
differ in at most two bits have a segment that differs in at most one bit, so
one of these holds:

* the high (or the low) segments are equal; the other segments then differ in
  at most two bits, and of their three parts one is equal too;
* each segment differs in exactly one bit: with that bit of the high segment
  cut out (a one-wildcard variant) the high segments are equal, and one half
  of the low segment is equal.

Every fingerprint is indexed under those keys (6 exact ones and one variant
for each high bit and low half), an equality join brings candidates together
and the full distance is checked.  A variant pairs only fingerprints that hold
different values at the bit cut out, so equal segments never meet there.  Work
is on distinct fingerprints; copies of a text cost one row.

Defined results: null, empty and white-space texts have fingerprint zero and are
linked like any other; fewer words than a shingle make one shingle of all; rows
that repeat a doc_id are rows of their own; a null doc_id is never a
component_id unless the whole component has none; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textscore.llm.common import map_batches, with_batch_columns, written

BLOCK = 1 << 16  # shingles whose bits are counted at a time


def text_fingerprint(text: str | None, shingle_words: int = 3, seed: int = 42) -> int:
    """SimHash of a text as a signed 64-bit integer."""
    # bytes.lower() and bytes.split() know ASCII letters and white space only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, join, k = xxhash.xxh64_digest, b" ".join, min(shingle_words, len(words))
    counts, n = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + k - 1]
        hashes = b"".join([digest(join(x), seed) for x in zip(*(part[i:] for i in range(k)))])  # noqa: B905
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame, text_col: str = "text", shingle_words: int = 3, out_col: str = "fp") -> DataFrame:
    """``docs`` plus its fingerprint as a long."""

    def make():
        return lambda texts: [[text_fingerprint(t, shingle_words) for t in texts]]

    return with_batch_columns(docs, [text_col], make, {out_col: ("bigint", pa.int64())})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """``(doc_id, fp)``, one row per input row."""

    def make():
        def step(batch):
            fps = [text_fingerprint(t, shingle_words) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

        return step

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col), make, "doc_id bigint, fp bigint")


def _bits(c: Column, low: int, n: int) -> Column:
    return F.shiftrightunsigned(c, low).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def _index_keys(fp: Column, bit: int) -> Column:
    """Keys of a fingerprint; of the variants those whose cut bit equals ``bit``."""
    high, low = _bits(fp, 32, 32), _bits(fp, 0, 32)

    def key(tag: int, a: Column, n: int, b: Column) -> Column:  # tag, 32 bits, n bits
        return F.lit(tag << 56).cast("long").bitwiseOR(F.shiftleft(a, n)).bitwiseOR(b)

    exact = [key(k, high, 11, _bits(low, s, n)) for k, (s, n) in enumerate(((0, 11), (11, 11), (22, 10)))]
    exact += [key(3 + k, low, 11, _bits(high, s, n)) for k, (s, n) in enumerate(((0, 11), (11, 11), (22, 10)))]
    variants = []
    for i in range(32):
        cut = high.bitwiseAND(F.lit(((1 << 32) - 1) ^ (1 << i)).cast("long"))
        holds = _bits(high, i, 1) == bit
        variants += [F.when(holds, key(6 + 2 * i + h, cut, 16, _bits(low, 16 * h, 16))) for h in (0, 1)]
    return F.array_compact(F.array(*exact, *variants))


def near_links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints that differ in at most ``max_bits`` (0 to 2) bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("two segments with one wildcard reach a distance of two bits")
    side = lambda bit, name: fps.select(F.col("fp").alias(name), F.explode(_index_keys(F.col("fp"), bit)).alias("key"))
    a, b = F.col("a"), F.col("b")
    exact = F.col("key") < F.lit(6 << 56)
    near = (F.bit_count(a.bitwiseXOR(b)) <= max_bits) & (~exact | (a < b))
    # merged by key: a side's size is guessed from the fingerprints' file, not from the 38 rows that each becomes
    pairs = side(0, "a").hint("merge").join(side(1, "b"), "key").where(near)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of an edge ``(a, b)``, root being the smallest node it reaches.

    Alternates two rounds that rewire each node's neighbours to the smallest of
    them (larger neighbours, then smaller ones) until nothing changes; the
    rounds grow with the logarithm of the longest path.  Each round is written
    to the shared folder; only its row count and checksum reach the driver.
    """
    edges, before = written(edges, "edges"), None
    for _ in range(max_rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        larger = both.where("b > a").join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        down = larger.where("a <> b").distinct()  # a > b
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(moved.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def fingerprint_components(rows: DataFrame, max_bits: int = 2) -> DataFrame:
    """``(fp, root, component_id)`` for the distinct fingerprints of ``rows(doc_id, fp)``."""
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected_components(near_links(nodes, max_bits))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 2
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``."""
    rows = written(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    comps = fingerprint_components(rows, max_bits)
    # every fp has a component; left, since many rows of few fingerprints make a small file but a large broadcast
    out = rows.join(comps, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_per_component(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id.

    The kept row is chosen by (doc_id, fingerprint), so a doc_id that repeats
    with another text is told apart; rows alike in both are one document.
    """
    marked = written(with_fingerprints(docs, "text", shingle_words, "_fp"), "marked")
    rows = marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_fp").alias("fp"))
    named = rows.groupBy("fp").agg(F.min("doc_id").alias("_id")).join(fingerprint_components(rows, max_bits), "fp")
    # by root: components of other texts can have the same smallest doc_id where ids repeat
    keep = named.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id"), F.col("fp").alias("_fp"))).alias("k"))
    keep = keep.select(F.col("k._id").alias("_kid"), F.col("k._fp").alias("_kfp"))
    same = marked["doc_id"].eqNullSafe(keep["_kid"]) & (marked["_fp"] == keep["_kfp"])
    return marked.join(keep, same, "left_semi").dropDuplicates(["doc_id", "_fp"]).select(*docs.columns)
