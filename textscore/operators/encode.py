"""Vocabulary, encoding and decoding as DataFrame plans.

The vocabulary is the top-k tokens plus a few special tokens; it is broadcast, and
one of more than ``MAX_VOCABULARY`` tokens fails the job.  Encoding and decoding explode a
row's tokens, look them up with a broadcast join, and re-assemble them in
position order.  Rows are hash-partitioned on their id and content *before* the
explode (one shuffle of raw text), so the re-assembly needs no second exchange
and only ever collects one row's own tokens.  An id may repeat: rows are told
apart by their content, and equal rows are encoded once and given back as often
as they came.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textscore.functions.encode import attention_mask, pad_to, specials_in_block, truncate_pad
from textscore.functions.text import get_tokenizer
from textscore.sources.io import to_encoded_layout
from textscore.operators.partitioning import cluster_rows

# Special tokens and their ids (pad first so ignore_index 0 is pad).
SPECIAL_TOKENS = [("<pad>", 0), ("</s>", 1), ("<unk>", 2)]
MAX_VOCABULARY = 1_000_000  # rows that are broadcast at most
PAD_TOKEN, EOS_TOKEN, UNK_TOKEN = "<pad>", "</s>", "<unk>"


def specials_frame(spark, specials: Sequence[tuple[str, int]] = SPECIAL_TOKENS) -> DataFrame:
    return spark.createDataFrame(list(specials), "token string, id int")


def build_vocabulary(
    texts: DataFrame,
    text_col: str,
    top_k: int,
    tokenizer: str | Callable[[Column], Column] = "words_and_symbols",
    lower: bool = False,
    specials: Sequence[tuple[str, int]] = SPECIAL_TOKENS,
) -> DataFrame:
    """``(token, id, special, freq)``: specials first, then the ``top_k`` most
    frequent tokens (ties by token), numbered after the specials.

    The count is a partial-aggregated ``groupBy``; the top-k is a
    ``TakeOrderedAndProject`` (no full sort); numbering runs on k rows only.
    """
    tok = get_tokenizer(tokenizer)
    c = F.col(text_col)
    words = texts.select(F.explode(tok(F.lower(c) if lower else c)).alias("token"))
    special_names = [s for s, _ in specials]
    counts = words.where(~F.col("token").isin(special_names)).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    top = counts.orderBy(F.desc("freq"), F.asc("token")).limit(top_k)
    base = max(i for _, i in specials) + 1 if specials else 0
    ranked = top.withColumn(
        "id", (F.row_number().over(Window.orderBy(F.desc("freq"), F.asc("token"))) - 1 + base).cast("int")
    )
    spark = texts.sparkSession
    sp = specials_frame(spark, specials).select("token", "id", F.lit(True).alias("special"), F.lit(None).cast("long").alias("freq"))
    return sp.unionByName(ranked.select("token", "id", F.lit(False).alias("special"), "freq"))


def resolve_pad(vocab: DataFrame) -> DataFrame:
    """The pad token and id (plus the vocabulary size); without a pad token
    the end token stands in."""
    pad = F.max(F.when(F.col("token") == PAD_TOKEN, F.col("id")))
    eos = F.max(F.when(F.col("token") == EOS_TOKEN, F.col("id")))
    return vocab.agg(
        F.coalesce(
            F.max(F.when(F.col("token") == PAD_TOKEN, F.col("token"))), F.max(F.when(F.col("token") == EOS_TOKEN, F.col("token")))
        ).alias("pad_token"),
        F.coalesce(pad, eos).alias("pad_id"),
        F.count(F.lit(1)).alias("vocab_size"),
    )


def bounded_vocabulary(vocab: DataFrame, max_rows: int = MAX_VOCABULARY) -> DataFrame:
    """``vocab`` for a broadcast: the job fails if it has more than ``max_rows`` rows."""
    rows = vocab.limit(max_rows + 1).agg(F.collect_list(F.struct(*vocab.columns)).alias("r"))
    too_long = F.raise_error(F.lit(f"a vocabulary of more than {max_rows} tokens is not broadcast")).cast(rows.schema["r"].dataType)
    return F.broadcast(rows.select(F.inline(F.when(F.size("r") > max_rows, too_long).otherwise(F.col("r")))))


def _vocab_lookup(vocab: DataFrame) -> DataFrame:
    return bounded_vocabulary(vocab.select("token", F.col("id").alias("_tid")))


def _distinct_rows(df: DataFrame, keys: Sequence[str], content: Sequence[str], cluster: bool) -> tuple[DataFrame, list[str]]:
    """The distinct rows of ``df`` with the columns that name one (ids and hashes of
    the content) and ``_copies``, how often it came."""
    rows = df.select(*keys, *content, F.xxhash64(*content).alias("_h1"), F.hash(*content).alias("_h2"))
    names = [*keys, "_h1", "_h2"]
    if cluster:
        rows = cluster_rows(rows, *names)
    once = rows.groupBy(*names).agg(*(F.first(c).alias(c) for c in content), F.count(F.lit(1)).cast("int").alias("_copies"))
    return once, [*names, "_copies"]


def _all_copies(df: DataFrame) -> DataFrame:
    """``df`` with each row as often as ``_copies`` says; drops the helper columns."""
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copy", "_copies", "_h1", "_h2")


def encode(
    df: DataFrame,
    id_col: str,
    text_col: str,
    vocab: DataFrame,
    out_col: str = "input_ids",
    tokenizer: str | Callable[[Column], Column] = "words_and_symbols",
    lower: bool = False,
    unk_id: int = 2,
    repartition: bool = True,
) -> DataFrame:
    """Text -> ``array<int>`` of vocabulary ids (unknown -> ``unk_id``).

    Output: ``id_col`` and ``out_col``, one row per row of ``df``; empty or null text
    gives an empty array.
    """
    tok = get_tokenizer(tokenizer)
    c = F.col(text_col)
    rows, names = _distinct_rows(df, [id_col], [text_col], repartition)
    toks = rows.select(*names, F.posexplode_outer(tok(F.lower(c) if lower else c)).alias("_pos", "token"))
    looked = toks.join(_vocab_lookup(vocab), "token", "left")
    ids = F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("_tid", F.lit(unk_id)).alias("_id")))
    seqs = looked.groupBy(*names).agg(F.sort_array(F.collect_list(ids))["_id"].cast("array<int>").alias(out_col))
    return _all_copies(seqs)


def decode(
    df: DataFrame,
    id_col: str,
    ids_col: str,
    vocab: DataFrame,
    out_col: str = "text",
    skip_special: bool = True,
    sep: str = " ",
    repartition: bool = True,
) -> DataFrame:
    """Ids -> text, dropping special ids; rows of only specials give ''.  One
    row per row of ``df``."""
    rows, names = _distinct_rows(df, [id_col], [ids_col], repartition)
    ex = rows.select(*names, F.posexplode_outer(ids_col).alias("_pos", "_tid"))
    looked = ex.join(bounded_vocabulary(vocab.select(F.col("id").alias("_tid"), "token", "special")), "_tid", "left")
    keep = F.col("token").isNotNull()
    if skip_special:
        keep = keep & ~F.coalesce(F.col("special"), F.lit(False))
    piece = F.when(keep, F.struct("_pos", "token"))
    texts = looked.groupBy(*names).agg(F.array_join(F.sort_array(F.collect_list(piece))["token"], sep).alias(out_col))
    return _all_copies(texts)


def decode_columns(df: DataFrame, id_col: str, columns: dict[str, str], vocab: DataFrame, keep_cols: Sequence[str] = (), sep: str = " ") -> DataFrame:
    """E6 for several id columns at once (``columns`` maps each to its text's name):
    they are stacked, looked up by one join and re-assembled.  Special ids are
    dropped; ``id_col`` and ``keep_cols`` pass through, one row per row of ``df``."""
    rows, names = _distinct_rows(df, [id_col, *keep_cols], list(columns), True)
    sides = F.array(*(F.struct(F.lit(k).alias("_side"), F.col(c).cast("array<int>").alias("_ids")) for k, c in enumerate(columns)))
    ids = rows.select(*names, F.inline(sides)).select(*names, "_side", F.posexplode_outer("_ids").alias("_pos", "_tid"))
    looked = ids.join(bounded_vocabulary(vocab.select(F.col("id").alias("_tid"), "token", "special")), "_tid", "left")
    piece = F.when(F.col("token").isNotNull() & ~F.coalesce(F.col("special"), F.lit(False)), F.struct("_side", "_pos", "token"))
    texts = looked.groupBy(*names).agg(F.sort_array(F.collect_list(piece)).alias("_all"))

    def text(k: int) -> Column:
        return F.array_join(F.transform(F.filter("_all", lambda x: x["_side"] == k), lambda x: x["token"]), sep)

    return _all_copies(texts.select(*names, *(text(k).alias(name) for k, name in enumerate(columns.values()))))


def encode_pairs(
    df: DataFrame,
    id_col: str,
    code_col: str,
    doc_col: str,
    vocab: DataFrame,
    block_size: int,
    pad_id: int = 0,
    unk_id: int = 2,
    tokenizer: str | Callable[[Column], Column] = "words_and_symbols",
    lower: bool = False,
    keep_cols: Sequence[str] = (),
    bos_id: int | None = None,
    eos_id: int | None = None,
) -> DataFrame:
    """E5 (+P2): the encoded pair layout ``input_ids, code_attention_mask,
    target_ids, docs_attention_mask``; the two text columns are dropped and
    ``keep_cols`` pass through.

    Both texts are encoded in one pass: they are stacked as two segments per
    row, cut to what the start and end id (if given) leave of ``block_size``,
    exploded, looked up once and re-assembled per row and side.  One row per row of
    ``df``.
    """
    tok = get_tokenizer(tokenizer)
    body = max(0, block_size - specials_in_block(bos_id, eos_id))

    def t(c):
        return F.slice(tok(F.lower(F.col(c)) if lower else F.col(c)), 1, body)

    rows, names = _distinct_rows(df, [id_col, *keep_cols], [code_col, doc_col], True)
    segs = rows.select(
        *names,
        F.inline(F.array(F.struct(F.lit(0).alias("_side"), t(code_col).alias("_t")), F.struct(F.lit(1).alias("_side"), t(doc_col).alias("_t")))),
    )
    toks = segs.select(*names, "_side", F.posexplode_outer("_t").alias("_pos", "token"))
    looked = toks.join(_vocab_lookup(vocab), "token", "left")
    ids = F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("_tid", F.lit(unk_id)).alias("_id")))
    seqs = looked.groupBy(*names, "_side").agg(
        F.sort_array(F.collect_list(ids))["_id"].cast("array<int>").alias("_ids")
    )
    both = _all_copies(
        seqs.groupBy(*names).agg(
            F.max(F.when(F.col("_side") == 0, F.col("_ids"))).alias("code_ids"),
            F.max(F.when(F.col("_side") == 1, F.col("_ids"))).alias("docs_ids"),
        )
    )
    padded = both.select(
        id_col,
        *keep_cols,
        truncate_pad("code_ids", block_size, pad_id, eos_id, bos_id).alias("_code_padded"),
        attention_mask("code_ids", block_size, eos_id, bos_id).alias("code_attention_mask"),
        truncate_pad("docs_ids", block_size, pad_id, eos_id, bos_id).alias("_docs_padded"),
        attention_mask("docs_ids", block_size, eos_id, bos_id).alias("docs_attention_mask"),
    )
    # Drop the unpadded sequences, rename to the encoded layout
    return to_encoded_layout(
        padded.drop("code_ids", "docs_ids"), {"_code_padded": "input_ids", "_docs_padded": "target_ids"}
    ).select(id_col, *keep_cols, "input_ids", "code_attention_mask", "target_ids", "docs_attention_mask")


def pad_batches(df: DataFrame, batch_col: str, ids_col: str, pad_id: int = 0, out_col: str | None = None) -> DataFrame:
    """Pad every row to the longest row of its batch (window per batch; a batch
    holds at most ``batch_size`` rows)."""
    w = Window.partitionBy(batch_col)
    longest = F.max(F.size(ids_col)).over(w)
    return df.withColumn(out_col or ids_col, pad_to(ids_col, longest, pad_id))
