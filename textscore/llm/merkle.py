"""Merkle manifest of a dataset, with octopus multiproofs.

Every row is a leaf.  Leaves of one group (a source) stand in the order of their
ids; every ``FAN`` consecutive nodes become their hash, level by level, and the
groups' roots become the root of all in the same way.  The trees are built block by
block: a block of ``FAN ** levels`` nodes is one row, whose inner levels come from
functions over its array, so a group with most of the rows is many blocks.

``prove`` works a *leaf partition* at a time (those rows to be proven that lie in
one block).  It lists the coordinates of the nodes that the partition cannot derive
from its own leaves - the minimal union over all its proofs, from the bottom to the
root -, fetches them with one join, derives the inner nodes its leaves share once,
and expands each leaf's own proof from them.  Coordinates near the roots, which
many partitions ask for, are salted.

Defined results: a null field is written ``-``; a null id stands first, a null group
is a group of its own and the first; rows with the same id and group are ordered by
their hashes; repeated rows are leaves of their own; columns other than those named
play no part; an empty table has no root and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textscore.operators.scan import number_rows, same_keys, stored

FAN = 3
LEVELS = 5  # a block is FAN ** LEVELS = 243 leaves
SALTED = 4  # levels below a root whose nodes are fetched by salted keys
SALTS = 64


# ------------------------------------------------------------------ hashing
def field(c: Column) -> Column:
    """A value as it enters a leaf: its bytes' count, ``:`` and itself; ``-`` if null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(*cols: Column) -> Column:
    return F.sha2(F.concat(*map(field, cols)), 256)


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def height_col(n: Column) -> Column:
    """``height`` of a count, exact up to 2**62."""
    powers = [FAN**k for k in range(40) if FAN**k < 1 << 62]
    return F.aggregate(F.array(*map(F.lit, powers)), F.lit(0), lambda acc, p: acc + (p < n).cast("int"))


# ------------------------------------------------------------------ building
@dataclass
class Manifest:
    """``leaves``: the rows with their place (``group``, ``n`` leaves in it, ``pos``),
    the group's place among the groups (``group_pos``); ``nodes``: every node above
    and including the leaves, ``tree`` 0 for the groups' trees and 1 for the tree over
    them; ``groups`` of them; the ``root`` (null without rows)."""

    leaves: DataFrame
    nodes: DataFrame
    groups: int
    root: str | None


def _next_level(nodes: Column) -> Column:
    runs = F.expr(f"cast((size(nodes) + {FAN - 1}) div {FAN} as int)")
    return F.transform(F.sequence(F.lit(0), runs - 1), lambda r: F.sha2(F.concat_ws("", F.slice(nodes, r * FAN + 1, FAN)), 256))


def tree(leaves: DataFrame, levels: int, name: str) -> DataFrame:
    """All nodes above leaves ``(group, n, pos, hash)``: ``(group, n, level, pos, hash)``.

    One round for each ``levels`` levels; a group leaves the rounds with its root.
    """
    block, out, base = FAN**levels, leaves.select("group", "n", F.lit(0).alias("level"), "pos", "hash"), 0
    top = leaves.agg(F.max("n")).first()[0] or 0
    current = out
    while top > FAN**base:
        held = current.where(F.lit(FAN**base) < F.col("n")).withColumn("block", F.expr(f"pos div {block}"))
        blocks = held.groupBy("group", "n", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]).alias("nodes"))
        kept = []
        for k in range(1, levels + 1):  # a level is there where the one below had several nodes
            below = FAN ** (base + k - 1)
            blocks = blocks.withColumn("nodes", F.when(F.col("n") > below, _next_level(F.col("nodes")))).withColumn(f"_l{k}", F.col("nodes"))
            kept.append(F.struct(F.lit(base + k).alias("level"), F.expr(f"block * {FAN ** (levels - k)}").alias("first"), F.col(f"_l{k}").alias("hashes")))
        found = blocks.select("group", "n", F.inline(F.array(*kept))).where("hashes is not null")
        found = found.select("group", "n", "level", "first", F.posexplode("hashes").alias("i", "hash"))
        found = stored(found.select("group", "n", "level", (F.col("first") + F.col("i")).alias("pos"), "hash"), name)
        out, base = out.unionByName(found), base + levels
        current = found.where(F.col("level") == base)
    return out


def build(rows: DataFrame, group_col: str, id_col: str, hash_col: str, keep: Sequence[str] = (), levels: int = LEVELS) -> Manifest:
    """The manifest of rows that already have their leaf hash; columns of ``keep`` stay with the leaves."""
    rows = stored(rows.select(group_col, id_col, hash_col, *keep), "leaves")  # texts are hashed once, not again for sampling and sorting
    by_group = rows.groupBy(F.col(group_col).alias("group")).agg(F.count(F.lit(1)).alias("n"))
    order = number_rows(by_group, ["group"], out_col="group_pos").withColumn("group_pos", F.col("group_pos") - 1)
    order = stored(order, "groups")
    groups = order.count()
    own = [id_col, hash_col, *keep]
    numbered = number_rows(rows, own, [group_col], out_col="pos").withColumn("pos", F.col("pos") - 1).withColumnRenamed(group_col, "group")
    renamed, on = same_keys(numbered, order, ["group"], "_g")
    leaves = stored(numbered.join(renamed, on, "left").select("group", "n", "group_pos", "pos", *own), "placed")
    low = tree(leaves.select("group", "n", "pos", F.col(hash_col).alias("hash")), levels, "nodes")
    roots = low.where(F.col("level") == height_col(F.col("n")))
    renamed, on = same_keys(roots, order.select("group", "group_pos"), ["group"], "_g")
    tops = roots.join(renamed, on).select(F.lit(None).cast("string").alias("group"), F.lit(groups).cast("long").alias("n"), F.col("group_pos").alias("pos"), "hash")
    high = tree(stored(tops, "roots"), levels, "nodes-above")
    root = high.where(F.col("level") == height(groups)).select("hash").first()
    kind = leaves.schema["group"].dataType
    nodes = low.withColumn("tree", F.lit(0)).unionByName(high.withColumn("group", F.lit(None).cast(kind)).withColumn("tree", F.lit(1)))
    return Manifest(leaves, nodes, groups, root[0] if root else None)


# ------------------------------------------------------------------ proving
def missing_coordinates(positions: Sequence[int], n: int) -> list[tuple[int, int]]:
    """``(level, pos)`` of the nodes that the proofs of these leaves need beyond what
    the leaves themselves give: the least that proves them all together."""
    out, known, level = [], sorted(set(positions)), 0
    while n > 1:
        here, runs = set(known), sorted({p // FAN for p in known})
        out += [(level, p) for r in runs for p in range(r * FAN, min(n, r * FAN + FAN)) if p not in here]
        known, n, level = runs, -(-n // FAN), level + 1
    return out


def _levels(leaves: dict[int, str], fetched: dict[tuple[int, int], str], n: int) -> list[dict[int, str]]:
    """Nodes by position, level by level: fetched ones and the shared inner ones derived once."""
    out, level = [], dict(leaves)
    while n > 1:
        runs = sorted({p // FAN for p in level})
        level |= {p: h for (lv, p), h in fetched.items() if lv == len(out)}
        out.append(level)
        level = {r: digest(level[p] for p in range(r * FAN, min(n, r * FAN + FAN))) for r in runs}
        n = -(-n // FAN)
    return [*out, level]


def proof(levels: list[dict[int, str]], pos: int, n: int) -> list[tuple[list[str], list[str]]]:
    """For each level the siblings left and right of the leaf's path."""
    steps = []
    for level in levels[:-1]:
        first = pos - pos % FAN
        steps.append(([level[p] for p in range(first, pos)], [level[p] for p in range(pos + 1, min(n, first + FAN))]))
        pos, n = pos // FAN, -(-n // FAN)
    return steps


def fold(leaf: str, steps: Iterable[tuple[list[str], list[str]]]) -> str:
    for left, right in steps:
        leaf = digest([*left, leaf, *right])
    return leaf


def prove(manifest: Manifest, hash_col: str, changed_col: str, id_col: str, subset: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """Proofs of the leaves (of those that ``subset`` picks): ``(id, leaf, subroot, root,
    proof, proof_sha256, folded_root, verified)``.

    ``proof`` lists the siblings from the leaf to the root, left to right.  A proof is
    folded from ``changed_col``, the leaf hash of the row as it is found now, and
    verified if that gives the manifest's root.
    """
    block, groups, root = FAN**levels, manifest.groups, manifest.root
    picked = manifest.leaves if subset is None else manifest.leaves.where(subset)
    part = ["group", "n", "group_pos", "block"]
    partitions = (
        picked.withColumn("block", F.expr(f"pos div {block}")).groupBy(*part)
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.col(hash_col).alias("leaf"), F.col(id_col).cast("long").alias("id"), F.col(changed_col).alias("changed")))).alias("held"))
    )
    partitions = stored(partitions, "partitions")

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for group, n, group_pos, number, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = [(0, lv, p, height(n)) for lv, p in missing_coordinates(held, n)]
                own += [(1, lv, p, height(groups)) for lv, p in missing_coordinates([group_pos], groups)]
                rows += [(group, number, t, lv, p, (number % SALTS if lv >= top - SALTED else 0)) for t, lv, p, top in own]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["group", "block", "tree", "level", "pos", "salt"])

    kind = manifest.leaves.schema["group"].dataType.simpleString()
    asked = partitions.select(*part, F.transform("held", lambda x: x["pos"]).alias("held"))
    asked = asked.mapInArrow(coordinates, f"group {kind}, block long, tree int, level int, pos long, salt long")
    # the group is null in the tree over the groups; its partitions keep their own name
    asked = asked.select(F.col("group").alias("asker"), "block", F.when(F.col("tree") == 0, F.col("group")).alias("group"), "tree", "level", "pos", "salt")
    near = F.col("level") >= F.when(F.col("tree") == 0, height_col(F.col("n"))).otherwise(F.lit(height(groups))) - SALTED
    salts = F.when(near, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    nodes = manifest.nodes.withColumn("salt", F.explode(salts)).withColumn("salt", F.col("salt").cast("long"))
    keys = ["tree", "level", "pos", "salt", "group"]
    renamed, on = same_keys(asked, nodes.select(*keys, "hash"), keys, "_n")
    fetched = asked.join(renamed, on).groupBy("asker", "block").agg(F.collect_list(F.struct("tree", "level", "pos", "hash")).alias("fetched"))
    fetched = fetched.select(F.col("asker").alias("group"), "block", "fetched")
    renamed, on = same_keys(partitions, fetched, ["group", "block"], "_f")
    # a partition that lacks nothing has no row on the right
    whole = partitions.join(renamed, on, "left").select("n", "group_pos", "held", "fetched")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, group_pos, held, got in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                nodes = ({}, {})
                for x in got or ():
                    nodes[x["tree"]][x["level"], x["pos"]] = x["hash"]
                low = _levels({x["pos"]: x["leaf"] for x in held}, nodes[0], n)
                subroot = low[-1][0]
                high = proof(_levels({group_pos: subroot}, nodes[1], groups), group_pos, groups)
                for x in held:
                    steps = proof(low, x["pos"], n) + high
                    siblings = [h for left, right in steps for h in (*left, *right)]
                    folded = fold(x["changed"], steps)
                    rows.append((x["id"], x["leaf"], subroot, root, siblings, digest(siblings), folded, folded == root))
            kinds = (pa.int64(), *[pa.string()] * 3, pa.list_(pa.string()), pa.string(), pa.string(), pa.bool_())
            names = ["id", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "id long, leaf string, subroot string, root string, proof array<string>, proof_sha256 string, folded_root string, verified boolean"
    return whole.mapInArrow(expand, schema)
