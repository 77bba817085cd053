"""Exact token counts at every prefix of a text, by dynamic programming.

The tokenizer never merges across white space, so the count after a word is the
count before it plus the word's own tokens; a cache holds the tokens of each
distinct word.  Inside a word the count at every character follows from the last
token alone: a byte-pair encoding without its last token is the encoding of the
text before that token, so ``count[i] = count[j] + 1`` for the one token that
ends at ``i`` and may follow the last token at ``j``.  Truncation and budget
questions are then look-ups, with no text encoded again.

Positions are characters (code points) of the raw text.  Defined results: a null
text counts as empty; special strings inside a text are one token each, as the
library's default has it; columns of the input other than the id and the text
play no part, rows that repeat are counted one by one.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textscore.llm.common import with_batch_columns

MAX_CACHED = 300_000  # distinct words whose counts a task keeps
# only ASCII white space: what else the tokenizer treats as white space stays
# inside a word, which the library then splits itself
SPACES = re.compile(r"[ \t\n\r\x0b\x0c]+")
SPLIT = re.compile(r"([ \t\n\r\x0b\x0c]+)")
SEPARATORS = re.compile(r"[\x1c-\x1f]")  # white space to Python, ordinary characters to the tokenizer
# words of these letters are normalised by lower-casing alone and cut as the
# tokenizer's own pattern (stated below, a fixed value) cuts them
PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-įı-ňŊ-ž]+")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
TOKENIZER_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def words_of(text: str) -> list[str]:
    if SEPARATORS.search(text):
        return [w for w in SPACES.split(text) if w]
    return text.split()


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in letters]
    letters |= {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class PrefixCounter:
    """Token counts of one tokenizer; lives in a task."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        model = json.loads(tokenizer_json)
        specials = [t["content"] for t in model["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        bpe = model["model"]
        self.end = bpe["end_of_word_suffix"] or ""
        self.vocab = bpe["vocab"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(bpe["merges"])}
        self.longest = max(map(len, self.vocab))
        self.letters = byte_letters()
        self.plain_cut = TOKENIZER_PIECE in json.dumps(model["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\")
        self.words: dict[str, int] = {}
        self.pieces: dict[str, int] = {}
        self.follows: dict[tuple, bool] = {}

    # ------------------------------------------------------------ whole words
    def _count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def learn(self, words: set[str]) -> None:
        """Put the counts of all these words in the cache."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > MAX_CACHED:
            self.words.clear()
            self.pieces.clear()
            new = list(words)
        other = []
        for w in new:
            if self.plain_cut and PLAIN.fullmatch(w) and not (self.special and self.special.search(w)):
                n = 0
                for p in PIECE.findall(w.lower()):
                    if p not in self.pieces:
                        letters = p if p.isascii() else "".join(self.letters[b] for b in p.encode())
                        self.pieces[p] = len(self.tokenizer.model.tokenize(letters))
                    n += self.pieces[p]
                self.words[w] = n
            else:
                other.append(w)
        for i in range(0, len(other), 10_000):
            part = other[i : i + 10_000]
            encoded = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.words.update(zip(part, map(len, encoded), strict=True))

    def count(self, words: list[str]) -> list[int]:
        """Tokens of each of the words (which ``learn`` has seen)."""
        known = self.words
        return [known[w] for w in words]

    def fitting_prefix(self, text: str, budget: int, words: list[str], counts: np.ndarray) -> int:
        """Length of the longest prefix of ``text`` with at most ``budget`` tokens.

        ``words`` are the text's words and ``counts`` the tokens after each.
        """
        if not len(counts) or counts[-1] <= budget:
            return len(text)
        past = int(np.searchsorted(counts, budget, side="right"))  # the first word that passes the budget
        start = 0
        for w in words[:past]:
            start = text.index(w, start) + len(w)
        start = text.index(words[past], start)
        # a later prefix of the word, or of those after it, can have fewer tokens again
        inside = (int(counts[past - 1]) if past else 0) + np.array([0, *self.inner(words[past])])
        return start + int(np.flatnonzero(inside <= budget)[-1])

    # ------------------------------------------------------------ every prefix
    def prefix_counts(self, text: str) -> np.ndarray:
        """Entry ``p`` is the number of tokens of ``text[:p]``."""
        out, at, done = np.zeros(len(text) + 1, np.int32), 0, 0
        for k, piece in enumerate(SPLIT.split(text)):
            n = len(piece)
            if k % 2:  # white space
                out[at + 1 : at + n + 1] = done
            elif n:
                out[at + 1 : at + n + 1] = np.array(self.inner(piece)) + done
                done = int(out[at + n])
            at += n
        return out

    def inner(self, word: str) -> list[int]:
        """Tokens of ``word[:1]``, ``word[:2]`` and so on to the whole word."""
        out, base = [], 0
        while self.special and (hit := self.special.search(word)):
            # up to its last character a special string is ordinary text
            plain = self._plain(word[: hit.end() - 1])
            base_next = base + (plain[hit.start() - 1] if hit.start() else 0) + 1
            out += [base + c for c in plain] + [base_next]
            word, base = word[hit.end() :], base_next
        return out + [base + c for c in self._plain(word)]

    def _plain(self, text: str) -> list[int]:
        spans: dict[int, list[int]] = {}
        encoded = self.tokenizer.encode(text, add_special_tokens=False)
        for part, (a, b) in zip(encoded.word_ids, encoded.offsets, strict=True):
            span = spans.setdefault(part, [a, b, 0])
            span[0], span[1], span[2] = min(span[0], a), max(span[1], b), span[2] + 1
        groups: list[list] = []  # start, end, tokens, whether one piece
        for a, b, n in spans.values():
            if groups and a < groups[-1][1]:  # one character became two pieces
                groups[-1] = [groups[-1][0], max(b, groups[-1][1]), groups[-1][2] + n, False]
            else:
                groups.append([a, b, n, True])
        out, base, at = [0] * len(text), 0, 0
        for a, b, n, one in groups:
            out[at:a] = [base] * (a - at)
            piece = text[a:b]
            if one and not (piece[0] == "'" and 1 < len(piece) <= 3 and piece[1:].isalpha()):
                inside = self._steps(piece)
            else:  # also 're and its like, which are cut differently when cut short
                inside = [self._count(piece[: k + 1]) for k in range(len(piece))]
            out[a:b] = [base + c for c in inside]
            base, at = base + n, b
        out[at:] = [base] * (len(text) - at)
        return out

    def _steps(self, piece: str) -> list[int]:
        """Counts at every prefix of a piece that the tokenizer encodes as one."""
        normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        last, counts, letters = [""], [0], ""  # by position; without the end-of-word mark
        out, block = [], ""
        for ch in piece:
            joins = unicodedata.category(ch)[0] == "M" or "ᄀ" <= ch <= "ᇿ"
            if block and not joins:  # nothing that follows can change what stands before ch
                letters = self._extend(last, counts, letters, normal(block))
                block = ""
            block += ch
            kept = len(letters)
            text = self._extend(last, counts, letters, normal(block))
            out.append(self._ending(last, counts, text))
            del last[kept + 1 :], counts[kept + 1 :]
        return out

    def _extend(self, last: list[str], counts: list[int], letters: str, more: str) -> str:
        letters += "".join(self.letters[b] for b in more.encode("utf-8", "surrogatepass"))
        for i in range(len(last), len(letters) + 1):
            for n in range(min(i, self.longest), 0, -1):
                token = letters[i - n : i]
                if token in self.vocab and self._may_follow(last[i - n], token, ""):
                    last.append(token)
                    counts.append(counts[i - n] + 1)
                    break
            else:
                raise ValueError(f"the vocabulary has no token for {letters[i - 1]!r}")
        return letters

    def _ending(self, last: list[str], counts: list[int], letters: str) -> int:
        i = len(letters)
        for n in range(min(i, self.longest), 0, -1):
            if letters[i - n :] + self.end in self.vocab and self._may_follow(last[i - n], letters[i - n :], self.end):
                return counts[i - n] + 1
        return 0 if not i else counts[i]

    def _may_follow(self, before: str, token: str, end: str) -> bool:
        key = (before, token, end)
        if key not in self.follows:
            if len(self.follows) > MAX_CACHED:
                self.follows.clear()
            symbols = [*before, *token[:-1], token[-1] + end]
            self.follows[key] = self._merge(symbols) == ([before] if before else []) + [token + end]
        return self.follows[key]

    def _merge(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            rank, i = min((self.ranks.get(p, 1 << 40), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 40:
                break
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols


def _maker(docs: DataFrame, tokenizer_path: str):
    with open(tokenizer_path, encoding="utf-8") as f:  # at most some MB, whatever the data
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    return lambda: PrefixCounter(shared.value)


def token_counts(docs: DataFrame, tokenizer_path: str, budget: int, text_col: str = "text", count_col: str = "n_tokens", fit_col: str | None = "fit_chars") -> DataFrame:
    """``docs`` plus the tokens of each whole text and, as ``fit_col``, the length
    of its longest prefix of at most ``budget`` tokens."""
    counter = _maker(docs, tokenizer_path)

    def make():
        c = counter()

        def step(texts):
            texts = [t or "" for t in texts]
            totals, fits = [], []
            for k in range(0, len(texts), 500):
                part = texts[k : k + 500]
                words = [words_of(t) for t in part]
                c.learn(set().union(*words))
                for t, ws in zip(part, words, strict=True):
                    counts = np.cumsum(c.count(ws))
                    totals.append(int(counts[-1]) if len(counts) else 0)
                    fits.append(c.fitting_prefix(t, budget, ws, counts) if fit_col else None)
            return [totals, fits] if fit_col else [totals]

        return step

    columns = {count_col: ("bigint", pa.int64())} | ({fit_col: ("bigint", pa.int64())} if fit_col else {})
    return with_batch_columns(docs, [text_col], make, columns)


def with_prefix_counts(docs: DataFrame, tokenizer_path: str, text_col: str = "text", out_col: str = "prefix_counts") -> DataFrame:
    """``docs`` plus the stored table: an array whose entry ``p`` (from 0) is the
    exact number of tokens of the first ``p`` characters."""
    counter = _maker(docs, tokenizer_path)

    def make():
        c = counter()
        return lambda texts: [[c.prefix_counts(t or "") for t in texts]]

    return with_batch_columns(docs, [text_col], make, {out_col: ("array<int>", pa.list_(pa.int32()))})


def tokens_in_prefix(prefix_counts: Column | str, chars: Column | int) -> Column:
    """Tokens of the first ``chars`` characters (of the whole text, if shorter)."""
    c = F.col(prefix_counts) if isinstance(prefix_counts, str) else prefix_counts
    n = F.lit(chars) if isinstance(chars, int) else chars
    return F.get(c, F.least(n, F.size(c) - 1).cast("int"))


def longest_fitting(prefix_counts: Column | str, budget: Column | int) -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens (a longer
    prefix can have fewer tokens, so the last position that fits is taken)."""
    c = F.col(prefix_counts) if isinstance(prefix_counts, str) else prefix_counts
    n = F.lit(budget) if isinstance(budget, int) else budget
    fits = F.reverse(F.transform(c, lambda x: x <= n))
    return F.size(c) - F.array_position(fits, F.lit(True)).cast("int")


def count_documents(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit, fit_chars)``, one row per input row."""
    rows = docs.select("doc_id", "text")
    out = token_counts(rows, tokenizer_path, limit)
    return out.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
        "fit_chars",
    )
