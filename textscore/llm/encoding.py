"""Token ids of whole texts, word by word, exactly as the tokenizer gives them.

The tokenizer drops white space and never joins across it, so a text's ids are
those of its words one after the other; a Python worker keeps the ids of the words
it has met, from task to task.  Memory is bounded: the cache is emptied when full,
and a text is taken in blocks that end at white space.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

from textscore.llm.token_counts import PIECE, PLAIN, TOKENIZER_PIECE, SPACES, byte_letters, words_of

MAX_WORDS = 500_000  # words, and half as many parts of words, that a worker keeps
MAX_WORD = 200  # longer words are not kept
BLOCK = 1 << 20  # characters taken at a time
PIECE_OR_END = re.compile(PIECE.pattern + r"|\n")


def blocks(text: str, size: int) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, each cut at white space."""
    at = 0
    while len(text) - at > size:
        cut = SPACES.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


class TextEncoder:
    """``ids(text)``: the ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, tokenizer_json: str):
        import json

        from tokenizers import Tokenizer

        model = json.loads(tokenizer_json)
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        specials = [t["content"] for t in model["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.letters = byte_letters()
        self.plain_cut = TOKENIZER_PIECE in json.dumps(model["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\")
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words not kept so far."""
        special, pieces, tokenize = self.special, self.pieces, self.tokenizer.model.tokenize
        plain = [w for w in words if self.plain_cut and PLAIN.fullmatch(w) and not ("<" in w and special and special.search(w))]
        new, out, k = {}, [], 0
        # all at once: a line end closes each word and is no part of any piece
        for p in PIECE_OR_END.findall("\n".join([*plain, ""]).lower()):
            if p == "\n":
                new[plain[k]] = out[0] if len(out) == 1 else b"".join(out)
                k += 1
                out = []
                continue
            ids = pieces.get(p)
            if ids is None:
                letters = p if p.isascii() else "".join([self.letters[b] for b in p.encode()])
                ids = array("I", [t.id for t in tokenize(letters)]).tobytes()
                if len(p) <= MAX_WORD:
                    pieces[p] = ids
            out.append(ids)
        other = [w for w in words if w not in new]
        for k in range(0, len(other), 10_000):
            part = other[k : k + 10_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                new[w] = array("I", e.ids).tobytes()
        return new

    def ids(self, text: str) -> bytes:
        out = []
        for block in blocks(text, BLOCK):
            words = words_of(block)
            known, long = self.words, ()
            unmet = set(words).difference(known)
            if unmet:
                old = self.old
                known.update({w: old[w] for w in unmet if w in old})
                known.update(self._learn([w for w in unmet if w not in known]))
                long = [w for w in unmet if len(w) > MAX_WORD]
            out.append(b"".join(map(known.__getitem__, words)))
            for w in long:
                del known[w]
            if len(known) > MAX_WORDS // 2:  # words in use come back from the old half
                self.old, self.words = known, {}
            if len(self.pieces) > MAX_WORDS // 2:
                self.pieces = {}
        return b"".join(out)

    def count(self, text: str) -> int:
        return len(self.ids(text)) // 4


_OWN: dict[str, TextEncoder] = {}


def encoder(tokenizer_json: str) -> TextEncoder:
    """This worker's encoder of a tokenizer (the last one used is kept)."""
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if key not in _OWN:
        _OWN.clear()
        _OWN[key] = TextEncoder(tokenizer_json)
    return _OWN[key]


def shared_tokenizer(spark, path: str):
    """The tokenizer's file, sent to the executors once (some MB, whatever the data)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())
