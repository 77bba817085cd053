"""URL filter: rules first, then the ratio of two character language models.

URLs that a rule allows or blocks are the accepted and rejected examples.  For
each side a variable-order Markov model (contexts of 0 to 5 bytes) is counted
over all of them.  A longer context is smoothed by the next shorter one and
counts for as much as has been seen after it, so no probability passes 1.  The
log-likelihood difference for each byte of the URL is turned into a probability
by a calibration on a fold of the examples that the counts left out
(``MAX_CALIBRATION`` different URLs of it at most).

The counts are a Spark table of exact byte n-grams, which grows with the URLs and
is never collected or broadcast.  Rows are cut into blocks of about 1 MB of URLs;
each block asks for the counts of the different n-grams it holds by one join, and
is scored by the answers alone.  An n-gram is asked for once by a block at most,
so none is a hot key.

Defined results: a null URL, or one without ``://``, has an empty host and path
and fits no rule; a null or empty URL is scored as the empty string; with
examples of one side only, that side's verdict is the method's (allow without
any); repeated rows are judged alike and count as often as they stand; a URL
longer than a block is a block of its own; an empty table gives no rows; other
columns than id and URL are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textscore.llm.common import map_batches, written

ORDER = 5  # bytes of context at most; an n-gram and its length fit into 64 bits
LENGTH_SHIFT = 8 * (ORDER + 1)
SMOOTHING = 3.0
FOLDS, CALIBRATION_FOLD = 5, 0
MAX_CALIBRATION = 20_000  # different URLs that fit the calibration's two numbers
BLOCK_BYTES = 1 << 20
START, END = b"\x02" * (ORDER + 1), b"\x03"

Rule = tuple[str, str]  # verdict, host and path


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (null if none), and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        on, slash, below = rule.partition("/")
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(slash + below)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _grams(urls: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The 1- to ORDER+1-grams that end at each byte, written as numbers (length,
    then the bytes); the bytes to predict; and where each URL's begin."""
    raw = [(u or "").encode("utf-8", "surrogatepass") for u in urls]
    x = np.frombuffer(b"".join(START + r + END for r in raw), np.uint8).astype(np.int64)
    lens = np.array([len(r) + 1 for r in raw], np.int64)
    begins = np.cumsum(lens) - lens
    told = np.arange(lens.sum()) + np.repeat(np.arange(1, len(raw) + 1) * len(START), lens)
    grams, g = [], np.zeros(len(x), np.int64)
    for k in range(ORDER + 1):
        g[k:] |= x[: len(x) - k] << (8 * k)
        grams.append(g | ((k + 1) << LENGTH_SHIFT))
    return grams, told, begins


def with_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with the number of each row's block (column ``block``); to be written,
    for the numbers hold for one reading of the rows."""

    def make():
        task, last = TaskContext.get().partitionId() << 33, [0]

        def step(batch):
            sizes = np.array([len(u or "") for u in batch.column("url").to_pylist()], np.int64)
            place = last[0] + np.cumsum(sizes) // BLOCK_BYTES
            last[0] = int(place[-1]) + 1 if len(place) else last[0]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(task + place)], names=[*batch.schema.names, "block"])

        return step

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    return map_batches(rows, make, ", ".join([*fields, "block bigint"]))


def block_grams(blocks: DataFrame) -> DataFrame:
    """``(block, gram, accepted, rejected)``: each n-gram of a block once, and how often
    it stands in the block's examples, from ``blocks(block, side int, url)``; rows
    whose side is null are no examples."""

    def count(table: pa.Table) -> pa.Table:
        side = np.array([-1 if s is None else s for s in table.column("side").to_pylist()], np.int64)
        grams, told, begins = _grams(table.column("url").to_pylist())
        # what stands before the first byte is a context too
        seen = np.concatenate((told, told[begins] - 1))
        sides = np.concatenate((np.repeat(side, np.diff(np.append(begins, len(told)))), side))
        out = []
        for g in grams:
            keys, at = np.unique(g[seen], return_inverse=True)
            out.append((keys, *(np.bincount(at[sides == s], minlength=len(keys)) for s in (0, 1))))
        keys, accepted, rejected = (np.concatenate(c) for c in zip(*out, strict=True))
        block = np.full(len(keys), table.column("block")[0].as_py(), np.int64)
        return pa.table({"block": block, "gram": keys, "accepted": accepted.astype(np.int64), "rejected": rejected.astype(np.int64)})

    return blocks.select("block", "side", "url").groupBy("block").applyInArrow(count, "block bigint, gram bigint, accepted bigint, rejected bigint")


def count_grams(grams: DataFrame) -> DataFrame:
    """``(gram, accepted, rejected)`` over all blocks, for n-grams of some example."""
    sums = grams.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    return sums.where((F.col("accepted") > 0) | (F.col("rejected") > 0))


def log_odds(urls: list[str | None], keys: np.ndarray, counts: Sequence[np.ndarray], totals: Sequence[float]) -> tuple[np.ndarray, float]:
    """For each URL the mean over its bytes of log P(accepted) - log P(rejected), and
    the largest probability met.

    ``keys`` are n-grams in ascending order, ``counts`` how often each stands in the
    accepted and the rejected examples (an absent one: never), ``totals`` the bytes
    of each side.
    """
    grams, told, begins = _grams(urls)

    def look(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, g), max(len(keys) - 1, 0))
        return at, keys[at] == g if len(keys) else np.zeros(len(g), bool)

    ends = [look(g[told]) for g in grams]
    contexts = [look(g[told - 1]) for g in grams[:-1]]

    def of(side: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        at, there = found
        return np.where(there, side[at], 0.0) if len(keys) else np.zeros(len(at))

    logs, largest = [], 0.0
    for side, total in zip(counts, totals, strict=True):
        p = (of(side, ends[0]) + 1) / (total + 257)
        for k in range(1, ORDER + 1):
            p = (of(side, ends[k]) + SMOOTHING * p) / (of(side, contexts[k - 1]) + SMOOTHING)
            largest = max(largest, float(p.max()))
        logs.append(np.log(p))
    return np.add.reduceat(logs[0] - logs[1], begins) / np.diff(np.append(begins, len(told))), largest


def score_blocks(blocks: DataFrame, grams: DataFrame, counts: DataFrame, totals: Sequence[float]) -> DataFrame:
    """``blocks`` with ``odds``, the log-likelihood difference of each row's URL, and
    ``largest``, the largest probability met in its block."""
    answers = grams.select("block", "gram").join(counts, "gram")

    def score(rows: pa.Table, told: pa.Table) -> pa.Table:
        keys = told.column("gram").to_numpy()
        order = np.argsort(keys)
        sides = [told.column(c).to_numpy()[order].astype(float) for c in ("accepted", "rejected")]
        odds, largest = log_odds(rows.column("url").to_pylist(), keys[order], sides, totals)
        return rows.append_column("odds", pa.array(odds)).append_column("largest", pa.array(np.full(len(odds), largest)))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema.fields]
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, ", ".join([*fields, "odds double", "largest double"]))


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(accepted) as a logistic function of the difference."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    scale = max(float(np.abs(x).max()), 1e-9)
    features, w = np.stack((x / scale, np.ones(len(x))), axis=1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -35, 35)))
        grad = features.T @ (p - y) + 1e-2 * w
        w -= np.linalg.solve((features * (p * (1 - p))[:, None]).T @ features + 1e-2 * np.eye(2), grad)
    return float(w[0] / scale), float(w[1])


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` for every row; ``score`` is
    the probability of acceptance by the method."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "ruled": verdict})
    blocks = written(with_blocks(rows), "url-blocks")
    side = F.when(F.col("ruled") == "allow", 0).when(F.col("ruled") == "block", 1)
    held = F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == CALIBRATION_FOLD
    grams = written(block_grams(blocks.withColumn("side", F.when(~held, side))), "url-grams")
    counts = written(count_grams(grams), "url-counts")
    bytes_of = counts.where(F.shiftright("gram", LENGTH_SHIFT) == 1).agg(F.sum("accepted"), F.sum("rejected")).first()
    totals = [float(n or 0) for n in bytes_of]
    if all(totals):
        scored = written(score_blocks(blocks, grams, counts, totals), "url-scores")
        # a bounded sample of the fold left out, each URL once
        fold = scored.where(held & F.col("ruled").isNotNull()).select("url", side.alias("side"), "odds").distinct()
        sample = fold.orderBy(F.xxhash64("url", F.lit(1)), "url").limit(MAX_CALIBRATION).select("side", "odds").collect()
        slope, offset = calibrate(np.array([r["odds"] for r in sample]), np.array([1.0 - r["side"] for r in sample]))
        z = F.greatest(F.least(F.col("odds") * slope + offset, F.lit(35.0)), F.lit(-35.0))
    else:
        scored, z = blocks, F.lit(-1.0 if totals[1] else 1.0)
    scored = scored.withColumn("score", 1 / (1 + F.exp(-z)))
    own = F.when(F.col("score") >= 0.5, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")
