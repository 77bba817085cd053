"""Trie of the prefixes that rebuilt conversations share.

A conversation is rebuilt from the head of another one and its own suffix.  Its
turns are not copied for that: a rebuilt turn is a reference to a stored turn, and
the fingerprint of a rebuilt prefix is computed from stored prefix sums.  A prefix
of turns ``x0, x1, ...`` has the fingerprint ``sum(x_i * B**i)`` modulo a prime, for
several primes; these form a monoid: a head's sum and a segment's difference of
sums, moved by a power of ``B``, combine to the fingerprint of the two in a row.

Rebuilt turns of equal depth and fingerprint form a node.  Each group is verified:
its members must come from one parent node and refer to stored turns of one
content key, and every content key must stand for one role and text among the
stored turns.  By induction over the depth a verified group is one sequence.
Should a check fail, all is done anew with other hashes (``seed``).

Subtree figures need no walk over the trie.  A node belongs to its smallest member;
the nodes of one owner form a chain from some depth to its end, so a subtree is the
rest of its owner's chain and the whole chains of those members whose own chains
begin deeper: sums over a chain, and over a node's members.

Defined results: rows without a ``conv_id`` belong to no conversation; a null role or
text is empty; a null turn comes first, equal turns are ordered by role, by the text's
first 64 characters and by the content key; repeated rows are turns of their own;
other columns play no part; a conversation without rebuilt turns is a member of the
root; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textscore.operators.scan import RANGE, number_rows, running_sums, stored

PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)  # products of two residues fit a long
HUBS = 5000  # nodes that hold more than this share (1 / HUBS) of all chains are at most HUBS
CHUNK = 1 << 16  # characters of ids joined in one row
NODE = ["depth", "k1", "k2"]


# ------------------------------------------------------------ fingerprints
def bases(primes: Sequence[int], seed: int) -> list[int]:
    rng = random.Random(seed)
    return [rng.randrange(p // 3, p - 1) for p in primes]


def power(base: int, prime: int, exponent: Column) -> Column:
    """``base ** exponent % prime`` for an exponent below 2**32, by look-up of its bytes."""
    out = None
    for k in range(4):
        table = ",".join(f"{pow(base, b << 8 * k, prime)}L" for b in range(256))
        digit = F.element_at(F.expr(f"array({table})"), (F.shiftright(exponent, 8 * k).bitwiseAND(F.lit(255)) + 1).cast("int"))
        out = digit if out is None else out * digit % prime
    return out


def content_terms(a: Column, b: Column, primes: Sequence[int]) -> list[Column]:
    low, mask = F.lit((1 << 31) - 1), [(a, 0), (a, 31), (b, 0), (b, 31)]
    return [F.shiftrightunsigned(c, s).bitwiseAND(low) % p for (c, s), p in zip(mask, primes, strict=True)]


def node_keys(f: Sequence[Column]) -> list[Column]:
    return [F.shiftleft(f[0], 31).bitwiseOR(f[1]), F.shiftleft(f[2], 31).bitwiseOR(f[3])]


def stored_turns(conversations: DataFrame, seed: int, primes: Sequence[int]) -> tuple[DataFrame, bool]:
    """The turns' references, each with its content key, its length and its conversation's
    prefix sums; and whether every content key stands for one role and text."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"a": F.xxhash64(F.lit(2 * seed), "role", "text"), "b": F.xxhash64(F.lit(2 * seed + 1), "role", "text")})
    same = rows.groupBy("a", "b").agg(F.min(F.struct("role", "text")).alias("lo"), F.max(F.struct("role", "text")).alias("hi"))
    sound = same.where(F.col("lo") != F.col("hi")).limit(1).count() == 0
    light = rows.select("conv_id", "turn", "role", F.substring("text", 1, 64).alias("first"), "a", "b", F.length("text").cast("long").alias("chars"))
    numbered = number_rows(light, ["turn", "role", "first", "a", "b"], ["conv_id"])
    x = numbered.select("conv_id", (F.col("rn") - 1).alias("i"), "a", "b", "chars").withColumn("range", F.expr(f"i div {RANGE}"))
    terms = content_terms(F.col("a"), F.col("b"), primes)
    x = x.withColumns({f"t{k}": t * power(g, p, F.col("i")) % p for k, (t, g, p) in enumerate(zip(terms, bases(primes, seed), primes, strict=True))})
    x = running_sums(x, ["conv_id"], ["i"], ["range"], {f"q{k}": f"t{k}" for k in range(4)})
    return stored(x.withColumns({f"q{k}": F.col(f"q{k}") % p for k, p in enumerate(primes)}), "turns"), sound


def rebuilt_turns(turns: DataFrame, base_of: Callable[[Column], Column], head_of: Callable[[Column], Column], longest_head: int, seed: int, primes: Sequence[int]) -> DataFrame:
    """One row for each conversation and depth, from 0: the node's key ``k1, k2``, its
    parent's ``j1, j2``, the content key and length of the last turn, and ``ends``."""
    conv, head = F.col("conv_id"), head_of(F.col("conv_id"))
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    own = turns.where(F.col("i") == head - 1).select("conv_id", *(F.col(f"q{k}").alias(f"o{k}") for k in range(4)))
    refs = F.struct("i", "a", "b", "chars", *(f"{x}{k}" for x in "qt" for k in range(4)))
    heads = turns.where(F.col("i") < longest_head).groupBy(conv.alias("base")).agg(F.array_sort(F.collect_list(refs)).alias("head"))
    info = counts.withColumn("base", base_of(conv)).join(own, "conv_id", "left").join(heads, "base", "left")
    info = info.withColumn("h", head_of(F.col("conv_id"))).withColumn("head", F.coalesce(F.slice("head", 1, F.col("h")), F.slice(F.array(refs_null(heads)), 1, 0)))
    info = info.withColumn("taken", F.size("head"))
    last = F.try_element_at("head", F.lit(-1))
    info = info.select(
        "conv_id", "n", "h", "taken", "head", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
        *(F.coalesce(f"o{k}", F.lit(0)).alias(f"o{k}") for k in range(4)),
        *(F.coalesce(last[f"q{k}"], F.lit(0)).alias(f"p{k}") for k in range(4)))
    info = stored(info, "heads")
    ends = (F.col("depth") == F.col("length")).alias("ends")
    none = F.lit(None).cast("long")
    root = info.withColumn("depth", F.lit(0)).select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"),
        none.alias("j1"), none.alias("j2"), none.alias("a"), none.alias("b"), F.lit(0).cast("long").alias("chars"), ends)

    def keyed(rows: DataFrame, f: list[Column], before: list[Column]) -> DataFrame:
        keys = dict(zip(("k1", "k2", "j1", "j2"), node_keys(f) + node_keys(before), strict=True))
        return rows.select("conv_id", "depth", *(c.alias(n) for n, c in keys.items()), "a", "b", "chars", ends)

    from_head = info.select("conv_id", "length", F.inline("head")).withColumn("depth", F.col("i") + 1)
    from_head = keyed(from_head, [F.col(f"q{k}") for k in range(4)], [F.pmod(F.col(f"q{k}") - F.col(f"t{k}"), F.lit(p)) for k, p in enumerate(primes)])
    # a conversation's facts stand by every range of its turns, so that no join key is hot
    spread = info.drop("head").withColumn("range", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RANGE}"))))
    rest = turns.where(F.col("i") >= head).join(spread, ["conv_id", "range"]).withColumn("depth", F.col("taken") + F.col("i") - F.col("h") + 1)
    f, before = [], []
    for k, (p, g) in enumerate(zip(primes, bases(primes, seed), strict=True)):
        back = F.element_at(F.array(*(F.lit(pow(g, -s, p)).cast("long") for s in range(longest_head + 1))), (F.col("h") - F.col("taken") + 1).cast("int"))
        segment = F.pmod(F.col(f"q{k}") - F.col(f"o{k}"), F.lit(p))
        moved = lambda c, back=back, k=k, p=p: (F.col(f"p{k}") + c * back % p) % p
        f.append(moved(segment))
        before.append(moved(F.pmod(segment - F.col(f"t{k}"), F.lit(p))))
    return stored(root.unionByName(from_head).unionByName(keyed(rest, f, before)), "rebuilt")


def refs_null(heads: DataFrame) -> Column:
    """A null of the type of a head's turn."""
    return F.lit(None).cast(heads.schema["head"].dataType.elementType)


# ------------------------------------------------------------------ nodes
def id_digests(rows: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """SHA-256 of each key's ids, ascending and joined by commas: ``keys`` and ``digest``.

    Ids are joined where a range partitioner puts them, so a key with most of the rows
    is joined by many tasks; one task then hashes that key's joined strings, one after
    the other, without holding them.
    """
    names = [*keys, "first", "ids"]
    kinds = [pa.int64()] * (len(keys) + 1) + [pa.string()]

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, None, [], 0
        for batch in batches:
            out = []
            for *k, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key or size > CHUNK:
                    if ids:
                        out.append((*key, first, ",".join(ids)))
                    key, first, ids, size = k, i, [], 0
                ids.append(str(i))
                size += len(ids[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, first, ",".join(ids)), kinds, strict=True)], names=names)

    def hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for *k, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if state:
                        out.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*keys, "digest"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], names=[*keys, "digest"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    longs = ", ".join(f"{k} long" for k in keys)
    ordered = rows.select(*keys, id_col).repartitionByRange(tasks, *keys, id_col).sortWithinPartitions(*keys, id_col)
    joined = ordered.mapInArrow(join_ids, f"{longs}, first long, ids string")
    return joined.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(hash_ids, f"{longs}, digest string")


def prefix_nodes(rebuilt: DataFrame) -> tuple[DataFrame, bool]:
    """One row for each node: owner ``conv_id``, members, those that end there, the last
    turn's length, the parent's key; and whether all groups are verified."""
    one = F.lit(True)
    for c in ("j1", "j2", "a", "b"):
        one = one & F.min(c).eqNullSafe(F.max(c))
    nodes = stored(rebuilt.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("ends").cast("long")).alias("n_ends"),
        F.max("chars").alias("chars"), F.max("j1").alias("j1"), F.max("j2").alias("j2"), one.alias("one")), "nodes")
    return nodes, nodes.where("not one").limit(1).count() == 0


def subtree_figures(rebuilt: DataFrame, nodes: DataFrame) -> DataFrame:
    """The result's rows but for the digests, with the node's key."""
    weight = (F.col("n_convs") - 1) * F.col("chars")
    childless = (F.col("n_convs") == F.col("n_ends")).cast("long")
    x = nodes.withColumns({"up": -F.col("depth"), "range": -F.expr(f"depth div {RANGE}"), "weight": weight, "leaf": childless, "unit": F.lit(1).cast("long")})
    x = running_sums(x, ["conv_id"], ["up"], ["range"], {"saved": "weight", "leaves": "leaf", "rest": "unit"})  # from a chain's end upwards
    chains = stored(nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum(weight).alias("chain_saved"), F.max(childless).alias("chain_leaf")), "chains")
    # what the chains that begin below a node, of other members of it, add
    spread = chains.where("top > 0").withColumn("range", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(top - 1) div {RANGE}"))))
    above = rebuilt.withColumn("range", F.expr(f"depth div {RANGE}")).join(spread, ["conv_id", "range"]).where("depth < top")
    below = above.groupBy(*NODE).agg(
        F.sum("chain_saved").alias("below_saved"), F.sum("chain_leaf").alias("below_leaves"), F.sum((F.col("depth") == F.col("top") - 1).cast("long")).alias("below_tops"))
    x = stored(x.join(below, NODE, "left").na.fill(0, ["below_saved", "below_leaves", "below_tops"]), "figures")
    # parents of the chains' first nodes: the few nodes with many of them are broadcast
    tops = x.select("conv_id", "depth", "j1", "j2").join(chains.select("conv_id", F.col("top").alias("depth")), ["conv_id", "depth"])
    tops = tops.where("depth > 0").select(F.col("conv_id").alias("of"), (F.col("depth") - 1).alias("depth"), F.col("j1").alias("k1"), F.col("j2").alias("k2"))
    many = max(1, chains.count() // HUBS)
    owners = x.select(*NODE, F.col("conv_id").alias("parent"), "below_tops")
    hubs = F.broadcast(owners.where(F.col("below_tops") > many).drop("below_tops"))
    found = tops.join(hubs, NODE, "left")
    rest = found.where("parent is null").drop("parent").join(owners.where((F.col("below_tops") > 0) & (F.col("below_tops") <= many)).drop("below_tops"), NODE)
    parents = found.where("parent is not null").unionByName(rest).select(F.col("of").alias("conv_id"), (F.col("depth") + 1).alias("depth"), "parent")
    x = x.join(parents, ["conv_id", "depth"], "left")
    return x.select(
        *NODE, "conv_id",
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"),
        "n_convs", "n_ends",
        (F.col("below_tops") + (F.col("rest") > 1).cast("long")).alias("n_children"),
        (F.col("leaves") + F.col("below_leaves")).alias("n_leaves"),
        (F.col("saved") + F.col("below_saved")).alias("saved_tokens"))


def trie(
    conversations: DataFrame, base_of: Callable[[Column], Column], head_of: Callable[[Column], Column], longest_head: int, seed: int = 0, primes: Sequence[int] = PRIMES
) -> DataFrame:
    """One row for each node of the trie over ``(conv_id, turn, role, text)``.

    Conversation ``c`` is the first ``head_of(c)`` (at most ``longest_head``) turns of
    conversation ``base_of(c)``, all if it has fewer, then its own after as many.
    """
    while True:
        turns, sound = stored_turns(conversations, seed, primes)
        rebuilt = rebuilt_turns(turns, base_of, head_of, longest_head, seed, primes)
        nodes, verified = prefix_nodes(rebuilt)
        if sound and verified:
            break
        seed += 1
    digests = id_digests(rebuilt.where("ends"), NODE, "conv_id")
    out = subtree_figures(rebuilt, nodes).join(digests, NODE, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
