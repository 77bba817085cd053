"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of words.  Only terms of the benchmark matter
for an inner product with it, so TF-IDF vectors are kept over those (hashed to at
most ``FEATURES``).  Document frequencies are counted over all passages; one
more pass over all passages gives a randomised SVD (each task sums A'AQ for a
random Q, the sum is a Nystroem factor of A'A), whose leading right singular
vectors span the latent space.  Overlapping windows of every document are then
compared with the benchmark items by cosine in that space, and each candidate is
checked by the longest common subsequence of words, for the whole item and for
its answer.  A subsequence of that length needs words of a certain TF-IDF weight
at least; items whose words a stretch of the document lacks are left out there.
Short items are compared with shorter windows too, and an item that stands word
for word in a document is found whatever its cosine.

Benchmark items are broadcast in blocks of about ``ITEM_BLOCK``.

Defined results: null and empty texts hold nothing; items without words match
nothing, items of fewer than ``SHORT`` words match only word for word; rows that
repeat are judged one by one; an empty benchmark or table gives no matches.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textscore.llm.common import map_batches, with_batch_columns

FEATURES = 1 << 17
PASSAGE = 64  # words of a passage in the statistics
STEP, FINE_STEP = 8, 2  # words; windows, and those under SMALLEST_WINDOW, start and end at multiples of it
SMALLEST_WINDOW = 32
FINE_WINDOWS = (8, 16)  # of short items, beside the smallest
COMMON = 0.1  # terms in a larger share of the passages get no weight
RANK, OVERSAMPLE = 96, 16
ITEM_BLOCK = 4096
MIN_COSINE = 0.2
MIN_LCS = 0.7
MIN_ANSWER = 0.5
SHORT = 8
TOKENS = 1 << 17  # words handled at a time
SEGMENT = 1024  # words of a document searched at a time, beside the overlap
TEXT_BLOCK = 1 << 20  # characters hashed at a time; only a word longer than this is cut
ANSWER = re.compile(r"(?is)^.*(?:\?|\banswer\s*:)(.*\w.*)$")

BASE = 0x100000001B3  # odd, so it has an inverse modulo 2**64
NO_WORD, IN_WORD, ONE_WORD = 0, 1, 2
# scripts written without blanks: Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han
UNSPACED = [
    (0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3041, 0x30FF), (0x31A0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF),
]


def _classes() -> np.ndarray:
    """Whether a character belongs to no word, to a word, or is one by itself."""
    out = np.full(0x110000, IN_WORD, np.uint8)
    for first, last in UNSPACED:
        out[first : last + 1] = ONE_WORD
    for c in range(128):
        out[c] = IN_WORD if chr(c).isalnum() or c == 95 else NO_WORD
    for c in range(128, 0x20000):  # no marks, blanks or symbols beyond
        if unicodedata.category(chr(c)) in ("Cc", "Pc", "Pd", "Pe", "Pf", "Pi", "Po", "Ps", "Sc", "Sk", "Sm", "So", "Zl", "Zp", "Zs"):
            out[c] = NO_WORD
    out[[0x200B, 0xFEFF]] = NO_WORD  # blanks of no width
    return out


CLASSES = _classes()


class Words:
    """Words of a text as 64-bit hashes, computed for all of them at once.

    A word is a run of letters, digits, underscores and marks of the lower-cased
    text; punctuation, blanks and symbols of any script end it.  In scripts written
    without blanks each character is a word.  Its hash is a polynomial in its
    characters, taken from one running sum over the text.
    """

    def __init__(self) -> None:
        self.powers, self.inverse = self._powers(BASE), self._powers(pow(BASE, -1, 1 << 64))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out = np.full(TEXT_BLOCK + 1, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def _hashes(self, x: np.ndarray, classes: np.ndarray) -> np.ndarray:
        word, one = classes != NO_WORD, classes == ONE_WORD
        apart = one[1:] | one[:-1] | ~word[1:] | ~word[:-1]  # between two neighbours
        starts = np.flatnonzero(word & np.concatenate(([True], apart))) if len(x) else np.zeros(0, np.int64)
        ends = np.flatnonzero(word & np.concatenate((apart, [True]))) + 1 if len(x) else starts
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * self.powers[: len(x)], dtype=np.uint64)))
        h = (sums[ends] - sums[starts]) * self.inverse[starts]
        h ^= h >> np.uint64(29)
        return h * np.uint64(0x9E3779B97F4A7C15)

    def of(self, text: str | None) -> np.ndarray:
        text = (text or "").lower()
        x = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = CLASSES[x]
        if len(x) <= TEXT_BLOCK:
            return self._hashes(x, classes)
        parts, at = [], 0
        while at < len(x):
            cut = min(at + TEXT_BLOCK, len(x))
            if cut < len(x):
                edges = np.flatnonzero(classes[at:cut] != IN_WORD)
                cut = at + int(edges[-1]) + 1 if len(edges) else cut
            parts.append(self._hashes(x[at:cut], classes[at:cut]))
            at = cut
        return np.concatenate(parts)


def bucket_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - 17)).astype(np.int64)


class Terms:
    """Position of each word's feature; words outside the benchmark get ``none``."""

    def __init__(self, features: np.ndarray):
        self.none = len(features)
        self.at = np.full(FEATURES, self.none, np.int64)
        self.at[features] = np.arange(self.none)

    def ids(self, words: np.ndarray) -> np.ndarray:
        return self.at[bucket_of(words)]


def _passages(texts: list[str | None], terms: Terms, words: Words):
    """Batches of ``(term, passage)`` for the benchmark terms, and the number of passages."""
    ids, at, passages, held = [], [], 0, 0
    for text in texts:
        every = words.of(text)
        for k in range(0, len(every), TOKENS):
            t = terms.ids(every[k : k + TOKENS])
            kept = np.flatnonzero(t != terms.none)
            ids.append(t[kept])
            at.append(passages + kept // PASSAGE)
            passages += -(-len(t) // PASSAGE)
            held += len(t)
            if held >= TOKENS:
                yield np.concatenate(ids), np.concatenate(at), passages
                ids, at, passages, held = [], [], 0, 0
    if ids:
        yield np.concatenate(ids), np.concatenate(at), passages


def _by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of ``values`` by key; the keys must be sorted."""
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], np.add.reduceat(values, starts, axis=0)


def benchmark_features(items: DataFrame) -> np.ndarray:
    def make():
        words = Words()

        def step(batch):
            found = [bucket_of(words.of(t)) for t in batch.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)), pa.int32())], names=["f"])

        return step

    # at most FEATURES rows come back
    return np.array(sorted(r["f"] for r in map_batches(items.select("text"), make, "f int").distinct().collect()), np.int64)


def term_weights(texts: DataFrame, items: DataFrame, features: np.ndarray) -> np.ndarray:
    """IDF of each feature over all passages; 0 for common ones.

    The terms of an item that would be left with fewer than four keep their IDF.
    """
    size = len(features)

    def make():
        terms, words = Terms(features), Words()

        def step(batch):
            df, n = np.zeros(size, np.int64), 0
            for ids, at, passages in _passages(batch.column(0).to_pylist(), terms, words):
                df += np.bincount(np.unique(at * (size + 1) + ids) % (size + 1), minlength=size)[:size]
                n += passages
            kept = np.flatnonzero(df)
            return pa.RecordBatch.from_arrays([pa.array(np.append(kept, -1), pa.int32()), pa.array(np.append(df[kept], n), pa.int64())], names=["t", "n"])

        return step

    sums = map_batches(texts.select("text"), make, "t int, n bigint").groupBy("t").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(size), 0
    for r in sums:  # one row for each feature at most
        if r["t"] < 0:
            total = r["n"]
        else:
            df[r["t"]] = r["n"]
    idf = np.log((total + 1) / (df + 0.5))
    rare = df <= COMMON * total

    def make_poor():
        terms, words = Terms(features), Words()

        def step(batch):
            found: set[int] = set()
            for text in batch.column(0).to_pylist():
                own = np.unique(terms.ids(words.of(text)))
                if np.count_nonzero(rare[own]) < 4:
                    found.update(own.tolist())
            return pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], names=["t"])

        return step

    poor = [r["t"] for r in map_batches(items.select("text"), make_poor, "t int").distinct().collect()]
    rare[poor] = True
    return np.where(rare, np.maximum(idf, 1e-3), 0.0)


def latent_basis(texts: DataFrame, features: np.ndarray, idf: np.ndarray, rank: int = RANK, seed: int = 3) -> np.ndarray:
    """Right singular vectors of the passages' TF-IDF matrix over the roots of
    their singular values (the leading ones), from one pass over all passages."""
    size = len(features)
    width = min(size, rank + OVERSAMPLE)
    probe = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]

    def make():
        terms, words = Terms(features), Words()
        weighted = (probe * idf[:, None]).astype(np.float32)

        def step(batch):
            total = np.zeros((size, width), np.float32)
            for ids, at, _ in _passages(batch.column(0).to_pylist(), terms, words):
                used = idf[ids] > 0
                ids, at = ids[used], at[used]
                if not len(ids):
                    continue
                _, y = _by_key(at, weighted[ids])
                of = np.cumsum(np.diff(at, prepend=at[0]) > 0)  # row of y of each term
                order = np.argsort(ids, kind="stable")
                keys, sums = _by_key(ids[order], y[of[order]])
                total[keys] += sums * idf[keys, None].astype(np.float32)
            kept = np.flatnonzero(total.any(axis=1))
            if not len(kept):
                return None
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(kept) + 1) * width, width), pa.int32()), pa.array(total[kept].ravel()))
            return pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), rows], names=["t", "z"])

        return step

    parts = map_batches(texts.select("text"), make, "t int, z array<float>")
    sums = parts.groupBy("t").agg(F.array(*(F.sum(F.get("z", F.lit(i)).cast("double")) for i in range(width))).alias("z")).collect()
    z = np.zeros((size, width))
    for r in sums:  # one row for each feature at most
        z[r["t"]] = r["z"]
    # A'A is about z (probe' z)^-1 z'
    core = probe.T @ z
    core = (core + core.T) / 2
    shift = 1e-7 * max(float(np.linalg.norm(z)), 1e-12)
    values, vectors = np.linalg.eigh(core + shift * np.eye(width))
    root = (z + shift * probe) @ (vectors / np.sqrt(np.maximum(values, shift)))
    left, strength, _ = np.linalg.svd(root, full_matrices=False)
    used = min(rank, int(np.count_nonzero(strength > 1e-2 * max(strength.max(), 1e-12))) or 1)
    # scaled down by the root of the singular values, so that directions that most
    # passages share don't rule; in full, small differences of alike passages would
    return left[:, :used] * np.sqrt((strength[0] or 1.0) / np.maximum(strength[:used], 1e-12))


def fit(docs: DataFrame, benchmark: DataFrame) -> dict | None:
    """Features, weights and latent basis over all passages; None for a benchmark without words."""
    features = benchmark_features(benchmark)
    if not len(features):
        return None
    texts = docs.select("text").union(benchmark.select("text"))
    idf = term_weights(texts, benchmark, features)
    return {"features": features, "idf": idf, "basis": latent_basis(texts, features, idf)}


# ------------------------------------------------------------------ checks
def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, with the rows of ``a`` as bits."""
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def answer_of(text: str, words: Words) -> list[int]:
    """What stands after the last question mark or ``answer:``, else the last fifth."""
    m = ANSWER.match(text)
    told = words.of(m[1]).tolist() if m else []
    every = words.of(text).tolist()
    return told or every[-max(3, len(every) // 5) :]


def holds_run(words: list, run: list) -> bool:
    return any(words[i : i + len(run)] == run for i, w in enumerate(words) if w == run[0])


class Matcher:
    """Holds one block of benchmark items against documents; lives in a task."""

    def __init__(self, model: dict, items: list[tuple[int, str]]):
        self.words, self.terms = Words(), Terms(model["features"])
        self.idf = np.append(model["idf"], 0.0)
        self.space = np.vstack((model["basis"] * model["idf"][:, None], np.zeros(model["basis"].shape[1]))).astype(np.float32)
        scales: dict[int, list[tuple]] = {}
        for item_id, text in items:
            hashes = self.words.of(text)
            if not len(hashes):
                continue
            ids, words = self.terms.ids(hashes), hashes.tolist()
            weights = np.sort(self.idf[ids])
            spare = len(words) - math.ceil(MIN_LCS * len(words))
            needed = float(weights[: len(weights) - spare].sum()) - 1e-6  # if the heaviest are those that miss
            window = SMALLEST_WINDOW
            while len(words) > window - window // 4 + 1:
                window *= 2
            fine = [w for w in FINE_WINDOWS if SHORT <= len(words) <= w - w // 4 + 1]
            entry = (self.space[ids].sum(axis=0), needed, (item_id, words, answer_of(text, self.words), ids))
            for w in (*fine, window):
                scales.setdefault(w, []).append(entry)
        self.scales = []  # window, latent vectors of length one, weights needed, terms, items
        for window, found in sorted(scales.items()):
            vectors = np.array([f[0] for f in found])
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            own = np.full((len(found), max(len(f[2][1]) for f in found)), self.terms.none)
            for row, f in zip(own, found, strict=True):
                row[: len(f[2][1])] = f[2][3]
            self.scales.append((window, vectors, np.array([f[1] for f in found]), own, [f[2] for f in found]))

    def _check(self, item: tuple, near: list[int], best: float) -> tuple[float, float] | None:
        """Shares of the item and of its answer, if both are high enough and the first beats ``best``."""
        _, words, answer, _ = item
        if len(words) < SHORT:
            share = float(holds_run(near, words))
        else:
            share = common_subsequence(words, near) / len(words)
        if share < MIN_LCS or share <= best:
            return None
        told = common_subsequence(answer, near) / len(answer)
        return (share, told) if told >= MIN_ANSWER else None

    def matches(self, text: str | None) -> list[tuple[int, float, float, float]]:
        """``(item_id, cosine, lcs share, answer share)`` of the items that the text holds."""
        words, found = self.words.of(text), {}
        for k in range(0, len(words) if self.scales else 0, SEGMENT):
            self._match_words(words[k : k + SEGMENT + 2 * self.scales[-1][0]], found)
        return [(i, *v) for i, v in sorted(found.items())]

    def _match_words(self, words: np.ndarray, found: dict[int, tuple]) -> None:
        ids = self.terms.ids(words)
        weights = self.idf[ids]
        used = np.flatnonzero(weights)
        if not len(used):
            return
        present = np.zeros(len(self.idf))
        present[ids] = self.idf[ids]
        possible = [np.flatnonzero(present[own].sum(axis=1) >= needed) for _, _, needed, own, _ in self.scales]
        if not any(map(len, possible)):
            return
        upto: dict[int, np.ndarray] = {}
        for (window, vectors, _, _, items), chosen in zip(self.scales, possible, strict=True):
            if not len(chosen):
                continue
            step = STEP if window >= SMALLEST_WINDOW else FINE_STEP
            steps, wide = -(-len(words) // step), window // step
            if step not in upto:
                upto[step] = self._latent_upto(used, ids, step, steps)
            starts = np.arange(0, max(1, steps - wide + wide // 4), wide // 4)
            ends = np.minimum(starts + wide, steps)
            latent = upto[step][ends] - upto[step][starts]
            latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
            cosines = latent @ vectors[chosen].T
            for i, j in zip(*np.nonzero(cosines >= MIN_COSINE), strict=True):
                item = items[chosen[j]]
                a, b = int(starts[i]) * step, int(ends[i]) * step
                beside = max(window // 4, (SMALLEST_WINDOW * 3 // 2 - window) // 2)
                near = words[max(0, a - beside) : b + beside].tolist()
                shares = self._check(item, near, found.get(item[0], (0, 0, 0))[1])
                if shares:
                    found[item[0]] = (float(cosines[i, j]), *shares)
            # the same items come with the larger windows
            for j, c in enumerate(chosen if window >= SMALLEST_WINDOW else ()):
                item = items[c]
                if found.get(item[0], (0, 0, 0))[1] < 1 and self._stands(item, words):
                    found[item[0]] = (float(cosines[:, j].max()), 1.0, 1.0)

    def _stands(self, item: tuple, words: np.ndarray) -> bool:
        """Whether the item stands word for word in ``words``."""
        run = np.array(item[1], np.uint64)
        if len(run) > len(words):
            return False
        rarest = int(np.argmax(self.idf[item[3]]))
        starts = np.flatnonzero(words[rarest : len(words) - len(run) + 1 + rarest] == run[rarest])
        return any((words[a : a + len(run)] == run).all() for a in starts.tolist())

    def _latent_upto(self, used: np.ndarray, ids: np.ndarray, step: int, steps: int) -> np.ndarray:
        """Latent vectors up to each multiple of ``step`` words."""
        at, sums = _by_key(used // step, self.space[ids[used]])
        upto = np.zeros((steps + 1, sums.shape[1]))
        upto[at + 1] = sums
        return np.cumsum(upto, axis=0)


def with_matches(docs: DataFrame, benchmark: DataFrame, out_col: str = "matches") -> DataFrame:
    """``docs`` plus an array of the benchmark items each text holds."""
    fields = [("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64())]
    sql = "array<struct<item_id:bigint,cosine:double,lcs:double,answer:double>>"
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    model = fit(docs, items)
    none = F.array().cast(sql)
    if model is None:
        return docs.withColumn(out_col, none)
    spark, parts = docs.sparkSession, []
    blocks = math.ceil(items.count() / ITEM_BLOCK)
    out = docs
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).distinct().collect()
        shared = spark.sparkContext.broadcast((model, [(r["item_id"], r["text"]) for r in block]))

        def make(shared=shared):
            m = Matcher(*shared.value)
            names = [n for n, _ in fields]
            return lambda texts: [[[dict(zip(names, x, strict=True)) for x in m.matches(t)] for t in texts]]

        parts.append(f"_matches_{b}")
        out = with_batch_columns(out, ["text"], make, {parts[-1]: (sql, pa.list_(pa.struct(fields)))})
    return out.withColumn(out_col, F.concat(*parts)).drop(*parts)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, cosine, lcs, answer)``: each benchmark item found in each document."""
    found = with_matches(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    name = "_held_items"
    return with_matches(docs, benchmark, name).where(F.size(name) == 0).select(*docs.columns)
