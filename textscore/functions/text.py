"""Text functions: tokenizers and n-grams as ``Column -> Column`` expressions.

Everything here is a built-in Spark expression chain (regexp_replace, split,
filter, transform), so it runs JVM-side inside whole-stage codegen or the
interpreted higher-order function path; no Python worker is involved unless a
user registers a Python tokenizer (``register_tokenizer`` with a pandas UDF).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference tokenizers for identical tokens).
#
# Unicode whitespace as Python's str.split()/\s understands it: Java's \s plus
# the information separators U+001C..U+001F, NEXT LINE U+0085 and every
# separator (Zs, Zl, Zp).
WHITESPACE_CLASS = r"[\s\x1c-\x1f\x85\p{Z}]"
# Python's \w on str: letters, numbers and underscore (no combining marks).
WORD_CLASS = r"[\p{L}\p{N}_]"
# Word runs or one character that is neither word nor whitespace.
WORDS_AND_SYMBOLS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"
# mteval-v13a regular-expression stage, applied in this order.  The first
# class is the published one minus the space character: padding a space with
# spaces only lengthens a whitespace run, which the final split removes, and
# skipping it halves the cost of the stage; its characters are listed one by one,
# which Java looks up in one table.  The second is published as
# ([^0-9])([.,]) -> "$1 $2 ", which tries two groups at every character; this one
# starts at a period or comma and takes the next one along, which the published
# pattern would use up as its first group.  The strings are the same.
REGEXP_STAGE = [
    # ASCII punctuation and symbols except apostrophe, comma, hyphen, period
    (r'([!"#$%&()*+/:;<=>?@\[\\\]^_`{|}~])', " $1 "),
    # period and comma unless preceded by a digit
    (r"([.,])(?<=[^0-9][.,])([.,]?)", " $1 $2"),
    # period and comma unless followed by a digit
    (r"([.,])([^0-9])", " $1 $2"),
    # dash when preceded by a digit
    (r"([0-9])(-)", "$1 $2 "),
]
# mteval-v13a language-independent stage: literal replacements in this order.
V13A_REPLACEMENTS = [
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
]
# ---------------------------------------------------------------------------


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whitespace_split(c: ColumnOrName) -> Column:
    """Split on runs of Unicode whitespace, dropping empty pieces (str.split())."""
    parts = F.split(_col(c), WHITESPACE_CLASS + "+")
    return F.array_remove(parts, "")


def words_and_symbols(c: ColumnOrName) -> Column:
    """Word runs and single non-space symbols, Unicode-aware."""
    return F.regexp_extract_all(_col(c), F.lit(WORDS_AND_SYMBOLS), F.lit(0))


def regexp_stage(c: ColumnOrName) -> Column:
    """The four ordered substitutions of the 13a regex stage (string out)."""
    out = _col(c)
    for pattern, repl in REGEXP_STAGE:
        out = F.regexp_replace(out, pattern, repl)
    return out


def tokenize_re(c: ColumnOrName) -> Column:
    """Regex stage then whitespace split."""
    return whitespace_split(regexp_stage(c))


def v13a_normalize(c: ColumnOrName) -> Column:
    """Language-independent part of 13a (skipped tags, hyphen-newline, entities)."""
    out = _col(c)
    for search, repl in V13A_REPLACEMENTS:
        out = F.replace(out, F.lit(search), F.lit(repl))
    return out


def tokenize_13a(c: ColumnOrName) -> Column:
    """Mteval-v13a tokenizer."""
    return tokenize_re(F.concat(F.lit(" "), v13a_normalize(c), F.lit(" ")))


def tokenize_chars(c: ColumnOrName) -> Column:
    """T4 'none': the identity tokenizer; n-grams then run over code points."""
    return F.regexp_extract_all(_col(c), F.lit("(?s)."), F.lit(0))


# T4: tokenizer registry.  Values map a text column to an array<string> column.
_TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "none": tokenize_chars,
    "re": tokenize_re,
    "13a": tokenize_13a,
    "words_and_symbols": words_and_symbols,
    "whitespace": whitespace_split,
}
# Tokenizers whose tokens never contain whitespace, so joining a gram's tokens
# with one space is injective (for 'none' every token is one code point, which
# keeps the joined form injective too).
_SPACE_SAFE = {"none", "re", "13a", "words_and_symbols", "whitespace"}


def register_tokenizer(name: str, fn: Callable[[Column], Column], space_safe: bool = False) -> None:
    """Add a custom tokenizer (a Column expression or a pandas UDF)."""
    _TOKENIZERS[name] = fn
    if space_safe:
        _SPACE_SAFE.add(name)
    else:
        _SPACE_SAFE.discard(name)


def get_tokenizer(tokenizer: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    if callable(tokenizer):
        return tokenizer
    try:
        return _TOKENIZERS[tokenizer]
    except KeyError:
        raise ValueError(f"unknown tokenizer {tokenizer!r}; known: {sorted(_TOKENIZERS)}") from None


def gram_key_is_string(tokenizer: str | Callable[[Column], Column]) -> bool:
    return isinstance(tokenizer, str) and tokenizer in _SPACE_SAFE


def tokenizer_names() -> list[str]:
    return sorted(_TOKENIZERS)


def ngrams_of_order(tokens: ColumnOrName, n: ColumnOrName, as_string: bool = True) -> Column:
    """T5 for one order: all contiguous n-grams (empty when the segment is shorter).

    Grams are joined with one space when ``as_string`` (injective for the
    built-in tokenizers), else kept as ``array<string>`` slices.
    """
    t, k = _col(tokens), _col(n)
    count = F.size(t) - k + 1
    idx = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    if as_string:
        return F.transform(idx, lambda i: F.array_join(F.slice(t, i, k), " "))
    return F.transform(idx, lambda i: F.slice(t, i, k))


def with_ngram_levels(df, tokens: str, max_order: int, as_string: bool = True, prefix: str = "_g"):
    """Add columns ``{prefix}1 .. {prefix}N``: all n-grams of each order.

    Order 1 is the token array itself; order k extends order k-1 by the next
    token (``zip_with``), so each gram costs one concatenation.  Each order is
    its own projection so the optimizer does not inline (and re-evaluate) the
    previous order.  Array grams (``as_string=False``) are slices instead.
    """
    t = F.col(tokens)
    out = df.withColumn(f"{prefix}1", F.transform(t, lambda x: F.array(x)) if not as_string else t)
    for k in range(2, max_order + 1):
        count = F.greatest(F.size(t) - k + 1, F.lit(0))
        if as_string:
            prev = F.slice(F.col(f"{prefix}{k - 1}"), 1, count)
            nxt = F.slice(t, k, count)
            col = F.when(count > 0, F.zip_with(prev, nxt, lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(
                F.array().cast("array<string>")
            )
        else:
            col = ngrams_of_order(t, F.lit(k), as_string=False)
        out = out.withColumn(f"{prefix}{k}", col)
    return out


def explode_ngrams(df, keys: list[str], tokens: str, max_order: int, as_string: bool = True):
    """T5 as rows ``(keys..., n, gram)`` for every n-gram of orders 1..max_order."""
    levels = with_ngram_levels(df.select(*keys, tokens), tokens, max_order, as_string)
    stacked = F.array(*[F.struct(F.lit(k).alias("n"), F.col(f"_g{k}").alias("grams")) for k in range(1, max_order + 1)])
    return levels.select(*keys, F.inline(stacked)).select(*keys, "n", F.explode("grams").alias("gram"))


def join_tokens(c: ColumnOrName, sep: str = " ", on_null: str = "raise") -> Column:
    """Join a token array with one space; a null array (an absent field) and null
    elements fail the job by default, with ``on_null="skip"`` they stay null or go."""
    col = _col(c)
    joined = F.array_join(col, sep)
    if on_null == "skip":
        return joined
    has_null = F.size(col) != F.size(F.array_compact(col))
    absent = F.when(col.isNull(), F.raise_error(F.lit("no token array")))
    return absent.when(has_null, F.raise_error(F.lit("null token in array"))).otherwise(joined)
