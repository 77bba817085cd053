import itertools
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import pyref
from conftest import SF001
from textscore.functions import text as T

EDGE = [
    "",
    "   ",
    "3½x x²",
    "é decomposed",
    "a‍b zero width joiner",
    "no break",
    "x\x1cy\x85z",
    "½ ² ٣ Ⅷ",
    "𝐀 😀 supplementary",
    "नमस्ते देवनागरी",
    "中文字没有空格",
    "&amp;lt; &quot;q&quot; a&gt;b",
    "hyphen-\nnewline",
    "a.,b 1,000.5 -3- x--y {[`~]} it's",
    "<skipped>gone",
]
ALPHABET = list("ab1 9.,-'\"&;<>{}[]`~!@#$%^*()_+=|\\/:?\n\t") + [" ", "　", "\x1c", "\x85", "é", "é", "½", "😀", "&amp;", "&lt;", "<skipped>"]


def _tokens(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    return {r.id: list(r.x) for r in df.select("id", fn("t").alias("x")).collect()}


def test_fixture_f5_13a(spark):
    got = _tokens(spark, ["&quot;a&amp;lt;b&gt; <skipped>foo-\nbar 1.5 3, a.b ,c 5-4 it's"], T.tokenize_13a)[0]
    assert got == ['"', "a", "<", "b", ">", "foobar", "1.5", "3", ",", "a", ".", "b", ",", "c", "5", "-", "4", "it's"]


def test_fixture_f6_words_and_symbols(spark):
    assert _tokens(spark, ["a_b c-d!"], T.words_and_symbols)[0] == ["a_b", "c", "-", "d", "!"]


def test_edge_rows_match_python(spark):
    for fn, ref in [(T.tokenize_13a, pyref.tok_13a), (T.tokenize_re, pyref.tok_re), (T.words_and_symbols, pyref.words_and_symbols), (T.tokenize_chars, list)]:
        got = _tokens(spark, EDGE, fn)
        for i, t in enumerate(EDGE):
            assert got[i] == ref(t), (fn.__name__, t)


def test_documents_and_pages_match_python(spark):
    docs = [r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").select("text").collect()]
    pages = [r.html for r in spark.read.parquet(f"{SF001}/pages.parquet").select("html").collect()]
    texts = docs + pages
    got13 = _tokens(spark, texts, T.tokenize_13a)
    got1 = _tokens(spark, texts, T.words_and_symbols)
    assert all(got13[i] == pyref.tok_13a(t) for i, t in enumerate(texts))
    assert all(got1[i] == pyref.words_and_symbols(t) for i, t in enumerate(texts))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join), min_size=1, max_size=30))
def test_fuzz_tokenizers(spark, texts):
    got13 = _tokens(spark, texts, T.tokenize_13a)
    gotre = _tokens(spark, texts, T.tokenize_re)
    for i, t in enumerate(texts):
        assert got13[i] == pyref.tok_13a(t), repr(t)
        assert gotre[i] == pyref.tok_re(t), repr(t)


def test_ngrams_levels_equal_slices(spark):
    df = spark.createDataFrame([(0, ["a", "b", "c", "d", "e"]), (1, ["x"]), (2, [])], "id long, t array<string>")
    lv = T.with_ngram_levels(df, "t", 4).orderBy("id").collect()
    assert lv[0]["_g1"] == ["a", "b", "c", "d", "e"]
    assert lv[0]["_g3"] == ["a b c", "b c d", "c d e"]
    assert lv[1]["_g2"] == [] and lv[2]["_g1"] == [] and lv[2]["_g4"] == []
    one = df.select(T.ngrams_of_order("t", F.lit(2)).alias("g")).orderBy(F.size("g").desc()).first().g
    assert one == ["a b", "b c", "c d", "d e"]


def test_join_tokens_null_raises(spark):
    import pytest

    df = spark.createDataFrame([(["a", None],)], "t array<string>")
    assert df.select(T.join_tokens("t", on_null="skip")).first()[0] == "a"
    with pytest.raises(Exception):
        df.select(T.join_tokens("t")).collect()


# the four substitutions as mteval-v13a publishes them
PUBLISHED = [(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")]


def test_regexp_stage_writes_the_published_strings(spark):
    rng = random.Random(3)
    marks = list("a19.,.,- ~!'") + ["é", "😀", "٣", "\n"]
    rows = [("".join(rng.choices(marks, k=rng.randint(0, 14))),) for _ in range(20_000)]
    rows += [("".join(p),) for k in range(6) for p in itertools.product("a1.,", repeat=k)]
    rows += [(f"x{chr(c)}y",) for c in range(1, 0x3100)]
    df = spark.createDataFrame(rows, "t string")
    for text in (F.col("t"), F.concat(F.lit(" "), "t", F.lit(" "))):
        second, whole = F.regexp_replace(text, *PUBLISHED[1]), text
        for pattern, repl in PUBLISHED:
            whole = F.regexp_replace(whole, pattern, repl)
        assert df.where(F.regexp_replace(text, *T.REGEXP_STAGE[1]) != second).count() == 0
        spaces = lambda c: F.regexp_replace(c, " +", " ")
        assert df.where(spaces(T.regexp_stage(text)) != spaces(whole)).count() == 0


def test_regexp_stage_starts_at_few_characters():
    # a pattern whose first class takes letters is tried in full at nearly every character
    for pattern, _ in T.REGEXP_STAGE:
        first = re.match(r"\(\[(?:\\.|[^\]])+\]\)", pattern).group()
        assert not re.search(first, "plain wörds"), pattern
