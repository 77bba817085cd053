"""Registered queries: one Spark plan per operator of the inventory, each with
an independent DuckDB statement of the same result (the oracle).

Every plan reads the given tables (or data Spark derives from them) in full.
Results are compared after rounding doubles to 6 decimals; arrays are
reported as counts and md5 digests of their joined form.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textscore.functions.encode import argmax, attention_mask, truncate_pad
from textscore.functions.text import (
    explode_ngrams,
    join_tokens,
    register_tokenizer,
    tokenize_13a,
    tokenize_re,
    whitespace_split,
    words_and_symbols,
)
from textscore.operators import batches as BT
from textscore.operators import bleu as B
from textscore.operators import checks as C
from textscore.operators import encode as E
from textscore.operators import evaluation as EV
from textscore.operators import flow as FL
from textscore.operators import metrics as M
from textscore.operators import runs as R
from textscore.operators.infer import argmax_predictor, predict_batches
from textscore.operators.ordering import epoch_micros
from textscore.plans import inputs as I
from textscore.plans import sql as S
from textscore.operators.partitioning import partitions_by_text
from textscore.operators.rows import merge_single_rows
from textscore.sources import io as IO
from textscore.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def fmt_bleu(df: DataFrame, group_cols: list[str] | tuple = (), max_order: int = 4) -> DataFrame:
    return df.select(
        *group_cols,
        F.round("bleu_score", 6).alias("bleu_score"),
        *[F.round(F.col("precisions")[k], 6).alias(f"precision_{k + 1}") for k in range(max_order)],
        F.round("brevity_penalty", 6).alias("brevity_penalty"),
        F.round("length_ratio", 6).alias("length_ratio"),
        F.col("translation_length").cast("long").alias("translation_length"),
        F.col("reference_length").cast("long").alias("reference_length"),
        F.col("pairs").cast("long").alias("pairs"),
    )


def digest(arr) -> F.Column:
    """md5 of an array joined with one space (same digest in DuckDB)."""
    return F.md5(F.array_join(arr, " "))


PAIRS_REFS = "prefs AS (SELECT id, 0 AS ref_no, ref FROM pairs)"
NEAR_REFS = "nrefs AS (SELECT id, 0 AS ref_no, ref FROM near)"


# ================================================================ scoring (A)
@register("a5_bleu_pairs", S.bleu_sql(f"{I.PAIRS_SQL}, {PAIRS_REFS}", "pairs", "prefs"))
def q_a5_bleu_pairs(spark, d):
    """A5 flagship: corpus BLEU (13a, plain) of assistant replies vs user turns."""
    return fmt_bleu(B.corpus_bleu(I.pairs(spark, d)))


@register("a5_bleu_duplicate_ids", S.bleu_sql(f"{I.NEAR_SQL}, {NEAR_REFS}", "near", "nrefs", smooth=True))
def q_a5_bleu_duplicate_ids(spark, d):
    # every id stands for thousands of pairs; each pair is still clipped on its own
    by_lang = I.near(spark, d).withColumn("id", F.col("lang"))
    return fmt_bleu(B.corpus_bleu(by_lang, smooth=True))


@register("a5_bleu_near_smooth_doubled", S.bleu_sql(f"{I.NEAR_SQL}, {NEAR_REFS}", "near", "nrefs", smooth=True, weight=2))
def q_a5_bleu_near_smooth(spark, d):
    """A5 smoothed with every pair counted twice (the reference wrapper's setting)."""
    return fmt_bleu(B.corpus_bleu(I.near(spark, d), smooth=True, pair_weight=2))


@register("a5_bleu_multi", S.bleu_sql(I.MULTI_SQL, "mpreds", "mrefs"))
def q_a5_bleu_multi(spark, d):
    """A5 with several references per prediction (long form, skew-safe path)."""
    preds, refs = I.multi(spark, d)
    return fmt_bleu(B.corpus_bleu(preds, refs))


@register("a6_bleu_by_lang", S.bleu_sql(f"{I.NEAR_SQL}, {NEAR_REFS}", "near", "nrefs", group_cols=["lang"]))
def q_a6_bleu_by_lang(spark, d):
    """Grouped BLEU per language."""
    return fmt_bleu(B.corpus_bleu(I.near(spark, d), group_cols=["lang"]), ["lang"])


@register(
    "a6_sentence_bleu_smooth",
    S.bleu_sql(f"{I.PAIRS_SQL}, {PAIRS_REFS}, sp AS (SELECT id AS pid, * FROM pairs)", "sp", "prefs", group_cols=["pid"], smooth=True),
)
def q_a6_sentence_bleu(spark, d):
    """A6 with one-row groups: smoothed sentence BLEU for every pair."""
    p = I.pairs(spark, d).withColumn("pid", F.col("id"))
    return fmt_bleu(B.corpus_bleu(p, group_cols=["pid"], smooth=True), ["pid"])


_BATCHED_PAIRS_SQL = f"""{I.PAIRS_SQL}, {PAIRS_REFS},
bp AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY md5('42:' || CAST(id AS VARCHAR))) - 1) / 8) AS BIGINT) AS batch_id FROM pairs)"""

_A7_SQL = f"""WITH {S.bleu_ctes(_BATCHED_PAIRS_SQL, "bp", "prefs", group_cols=["batch_id"], smooth=True)}
SELECT round(coalesce(avg(geo * bp), 0.0), 6) AS macro_bleu, CAST(count(*) AS BIGINT) AS batches FROM fin"""


@register("a7_macro_bleu_batches", _A7_SQL)
def q_a7_macro(spark, d):
    """Smoothed BLEU per evaluation batch of 8 (seeded shuffle), then the
    unweighted mean over batches."""
    p = BT.assign_batches(I.pairs(spark, d), "id", 8, shuffle=True, seed=42)
    per_batch = B.corpus_bleu(p, group_cols=["batch_id"], smooth=True)
    return per_batch.agg(
        F.round(F.coalesce(F.avg("bleu_score"), F.lit(0.0)), 6).alias("macro_bleu"),
        F.count(F.lit(1)).cast("long").alias("batches"),
    )


@register(
    "a8_exact_match_by_lang",
    f"""WITH {I.NEAR_SQL}
SELECT lang, round(avg(CASE WHEN lower(upper(pred)) = lower(ref) THEN 1.0 ELSE 0.0 END), 6) AS exact_match,
       CAST(sum(CASE WHEN lower(upper(pred)) = lower(ref) THEN 1 ELSE 0 END) AS BIGINT) AS hits,
       CAST(count(*) AS BIGINT) AS pairs
FROM near GROUP BY lang""",
)
def q_a8_exact_match(spark, d):
    """Case-insensitive exact match (predictions upper-cased)."""
    p = I.near(spark, d).withColumn("pred", F.upper("pred"))
    em = M.exact_match(p, group_cols=["lang"])
    return em.select("lang", F.round("exact_match", 6).alias("exact_match"), "hits", F.col("pairs").cast("long").alias("pairs"))


_LOSS_SQL = """lossrows AS (
  SELECT id, target,
         list_max(list_transform(logits, lambda x: CAST(x AS DOUBLE))) AS m,
         list_transform(logits, lambda x: CAST(x AS DOUBLE)) AS l
  FROM logits),
losses AS (SELECT id, target, m + ln(list_sum(list_transform(l, lambda x: exp(x - m)))) - l[target + 1] AS loss FROM lossrows WHERE target <> 0)"""


@register(
    "a9_cross_entropy",
    f"""WITH {I.LOGITS_SQL}, {_LOSS_SQL},
batched AS (SELECT *, floor((row_number() OVER (ORDER BY md5('7:' || CAST(id AS VARCHAR))) - 1) / 64) AS batch_id FROM logits),
bl AS (SELECT b.batch_id, avg(x.loss) AS bl FROM losses x JOIN batched b USING (id) GROUP BY b.batch_id)
SELECT round((SELECT avg(loss) FROM losses), 6) AS pooled_loss,
       round((SELECT avg(bl) FROM bl), 6) AS eval_loss,
       CAST((SELECT count(*) FROM losses) AS BIGINT) AS positions""",
)
def q_a9_cross_entropy(spark, d):
    """Masked cross-entropy (target 0 ignored): pooled and mean of batch means."""
    lg = I.logits(spark, d)
    batched = BT.assign_batches(lg, "id", 64, shuffle=True, seed=7)
    by_batch = M.cross_entropy(batched, batch_col="batch_id")
    return by_batch.select(
        F.round("pooled_loss", 6).alias("pooled_loss"),
        F.round("eval_loss", 6).alias("eval_loss"),
        F.col("positions").cast("long").alias("positions"),
    )


@register(
    "a10_epoch_loss",
    f"""WITH {I.RUNLOG_SQL}
SELECT run, epoch, {I.exact_mean5_sql(f"sum({I.CENTS_SQL})", "count(*)")} AS train_loss,
       CAST(count(*) AS BIGINT) AS steps FROM steps GROUP BY run, epoch""",
)
def q_a10(spark, d):
    """A10: mean loss per run and epoch, 5 decimals."""
    steps = I.exact_loss(I.runlog_steps(spark, d))
    return R.epoch_mean_loss(steps).select(
        "run", "epoch", F.col("train_loss").cast("double").alias("train_loss"), F.col("steps").cast("long").alias("steps")
    )


@register(
    "a11_eval_report",
    f"""WITH bl AS ({S.bleu_sql(f"{I.NEAR_SQL}, {NEAR_REFS}", "near", "nrefs", smooth=True, weight=2)}),
{I.NEAR_SQL}, {I.LOGITS_SQL}, {_LOSS_SQL}
SELECT 'eval_bleu_score' AS metric, round(bleu_score, 4) AS value FROM bl
UNION ALL SELECT 'eval_EM_score' AS metric, round(avg(CASE WHEN lower(pred) = lower(ref) THEN 1.0 ELSE 0.0 END), 4) AS value FROM near
UNION ALL SELECT 'eval_loss', round(avg(loss), 4) FROM losses""",
)
def q_a11(spark, d):
    """Evaluation metrics (BLEU as the evaluation loop takes it, exact match,
    loss) unpivoted, names sorted, 4 decimals."""
    near = I.near(spark, d)
    bleu = fmt_bleu(B.corpus_bleu(near, smooth=True, pair_weight=2)).select(F.col("bleu_score").alias("eval_bleu_score"))
    em = M.exact_match(near).select(F.col("exact_match").alias("eval_EM_score"))
    loss = M.cross_entropy(I.logits(spark, d)).select("eval_loss")
    return M.eval_report(merge_single_rows(bleu, em, loss))


_RUN_NEAR_SQL = f"""{I.NEAR_SQL}, rn AS (SELECT id % 4 AS run, * FROM near), {NEAR_REFS}"""
_A12_SQL = f"""WITH {S.bleu_ctes(_RUN_NEAR_SQL, "rn", "nrefs", group_cols=["run"])},
em AS (SELECT run, avg(CASE WHEN lower(pred) = lower(ref) THEN 1.0 ELSE 0.0 END) AS exact_match FROM rn GROUP BY run),
sc AS (SELECT CAST(run AS BIGINT) AS run, round(geo * bp, 6) AS bleu_score, round(exact_match, 6) AS exact_match
       FROM fin JOIN em USING (run))
SELECT run, bleu_score, exact_match,
       CAST(rank() OVER (ORDER BY bleu_score DESC, exact_match DESC, run) AS INTEGER) AS rank FROM sc"""


@register("a12_run_comparison", _A12_SQL)
def q_a12(spark, d):
    """BLEU and exact match per run side by side, ranked."""
    near = I.near(spark, d).withColumn("run", (F.col("id") % 4).cast("long"))
    bl = B.corpus_bleu(near, group_cols=["run"]).select("run", F.round("bleu_score", 6).alias("bleu_score"))
    em = M.exact_match(near, group_cols=["run"]).select("run", F.round("exact_match", 6).alias("exact_match"))
    return R.rank_runs(bl.join(em, "run")).select("run", "bleu_score", "exact_match", "rank")


@register("a13_merged_partials", S.bleu_sql(f"{I.NEAR_SQL}, {NEAR_REFS}", "near", "nrefs", smooth=True))
def q_a13(spark, d):
    """Partial states per chunk of documents (8 chunks), merged, finalized;
    equals scoring the whole corpus at once."""
    near = I.near(spark, d).withColumn("chunk", F.col("id") % 8)
    parts = B.bleu_components(near, group_cols=["chunk"])
    merged = B.merge_components(parts)
    return fmt_bleu(B.bleu_finalize(merged, smooth=True))


# ====================================================== joins and n-grams
@register(
    "j1_pairing",
    f"""WITH {I.MULTI_SQL},
rid AS (SELECT DISTINCT id FROM mrefs)
SELECT CAST((SELECT count(*) FROM mpreds p JOIN rid USING (id)) AS BIGINT) AS paired_ids,
       CAST((SELECT count(*) FROM mpreds p ANTI JOIN rid USING (id)) AS BIGINT) AS preds_without_ref,
       CAST((SELECT count(*) FROM mrefs r ANTI JOIN mpreds USING (id)) AS BIGINT) AS refs_without_pred""",
)
def q_j1(spark, d):
    """Pairing by id with the unmatched rows on both sides counted."""
    pairs, no_ref, no_pred = B.pair_predictions(*I.multi(spark, d))
    return merge_single_rows(
        pairs.agg(F.count_distinct("id").alias("paired_ids")),
        no_ref.agg(F.count(F.lit(1)).alias("preds_without_ref")),
        no_pred.agg(F.count(F.lit(1)).alias("refs_without_pred")),
    )


_J2_SQL = f"""WITH {I.NEAR_SQL}, {NEAR_REFS},
seg AS (SELECT id, -1 AS side, {S.tok_13a('pred')} AS t FROM near UNION ALL SELECT id, 0, {S.tok_13a('ref')} FROM nrefs),
grams AS ({S.grams_cte('seg', 'id, side', 4)}),
cnt AS (SELECT id, n, g, count(*) FILTER (WHERE side < 0) AS pc, count(*) FILTER (WHERE side >= 0) AS rc FROM grams GROUP BY ALL)
SELECT n, CAST(sum(least(pc, rc)) AS BIGINT) AS matches, CAST(sum(pc) AS BIGINT) AS possible,
       CAST(count(*) FILTER (WHERE least(pc, rc) > 0) AS BIGINT) AS shared_grams
FROM cnt GROUP BY n"""


@register("j2_clipped_matches_by_order", _J2_SQL)
def q_j2(spark, d):
    """J2 + A3 + A4: multiset intersection per (pair, gram), clipped matches and
    possible matches summed per order."""
    return B.clipped_by_order(I.near(spark, d)).select(F.col("n").cast("long").alias("n"), "matches", "possible", "shared_grams")


_T5_SQL = f"""WITH seg AS (SELECT item_id AS id, {S.tok_13a('text')} AS t FROM benchmark),
grams AS ({S.grams_cte('seg', 'id', 4)})
SELECT id AS item_id, n, g AS gram, CAST(count(*) AS BIGINT) AS cnt FROM grams GROUP BY ALL"""


@register("a1_t5_ngram_counts", _T5_SQL)
def q_a1(spark, d):
    """T5 + A1: every n-gram (orders 1-4) of every benchmark passage with its count."""
    bench = I.table(spark, d, "benchmark").select(F.col("item_id"), tokenize_13a("text").alias("t"))
    grams = explode_ngrams(bench, ["item_id"], "t", 4)
    return grams.groupBy("item_id", "n", "gram").agg(F.count(F.lit(1)).alias("cnt")).select(
        "item_id", F.col("n").cast("long").alias("n"), "gram", "cnt"
    )


_A2_SQL = f"""WITH {I.MULTI_SQL},
seg AS (SELECT id, ref_no AS side, {S.tok_13a('ref')} AS t FROM mrefs),
grams AS ({S.grams_cte('seg', 'id, side', 4)}),
per_ref AS (SELECT id, side, n, g, count(*) AS c FROM grams GROUP BY ALL),
merged AS (SELECT id, n, g, max(c) AS c FROM per_ref GROUP BY id, n, g)
SELECT id, n, CAST(count(*) AS BIGINT) AS distinct_grams, CAST(sum(c) AS BIGINT) AS merged_count FROM merged GROUP BY id, n"""


@register("a2_reference_union", _A2_SQL)
def q_a2(spark, d):
    """A2: multiset union over references (per gram the largest count in any one
    reference), summarized per conversation and order."""
    _, refs = I.multi(spark, d)
    texts = I.table(spark, d, "conversations").where(F.col("role") == "assistant")
    merged = B.reference_union(refs, num_partitions=partitions_by_text(texts, "text"))
    return merged.groupBy("id", "n").agg(
        F.count(F.lit(1)).alias("distinct_grams"), F.sum("c").cast("long").alias("merged_count")
    ).select("id", F.col("n").cast("long").alias("n"), "distinct_grams", "merged_count")


# ================================================================ text (T)
def _tok_summary_sql(tok, table: str, id_col: str, text_col: str) -> str:
    return f"""SELECT k AS id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS digest
FROM (SELECT {id_col} AS k, {tok(text_col)} AS t FROM {table})"""


def _tok_summary(df: DataFrame, id_col: str, tokens) -> DataFrame:
    x = df.select(F.col(id_col).alias("id"), tokens.alias("t"))
    return x.select("id", F.size("t").cast("long").alias("n_tokens"), digest(F.col("t")).alias("digest"))


@register("t1_words_and_symbols", _tok_summary_sql(S.tok_t1, "documents", "doc_id", "text"))
def q_t1(spark, d):
    """Word runs and single symbols over every document."""
    return _tok_summary(I.table(spark, d, "documents"), "doc_id", words_and_symbols("text"))


@register(
    "t2_tokenize_13a",
    _tok_summary_sql(S.tok_13a, "documents", "doc_id", "text")
    + "\nUNION ALL\n"
    + _tok_summary_sql(S.tok_13a, "pages", "page_id + 1000000000", "html"),
)
def q_t2(spark, d):
    """Mteval-v13a tokens of every document and every raw HTML page."""
    docs = _tok_summary(I.table(spark, d, "documents"), "doc_id", tokenize_13a("text"))
    pages = I.table(spark, d, "pages").withColumn("pid", F.col("page_id") + 1000000000)
    return docs.unionByName(_tok_summary(pages, "pid", tokenize_13a("html")))


@register("t3_tokenize_re", _tok_summary_sql(S.tok_re, "documents", "doc_id", "text"))
def q_t3(spark, d):
    """The regex stage alone (newlines are kept as whitespace)."""
    return _tok_summary(I.table(spark, d, "documents"), "doc_id", tokenize_re("text"))


@register("t4_char_bleu_pairs", S.bleu_sql(f"{I.PAIRS_SQL}, {PAIRS_REFS}", "pairs", "prefs", tokenizer="none"))
def q_t4(spark, d):
    """T4: registry choice 'none' (character n-grams) for BLEU."""
    return fmt_bleu(B.corpus_bleu(I.pairs(spark, d), tokenizer="none"))


def _whitespace_tokenizer(c):
    return whitespace_split(c)


register_tokenizer("user_whitespace", _whitespace_tokenizer, space_safe=True)


@register("u1_custom_tokenizer_bleu", S.bleu_sql(f"{I.NEAR_SQL}, {NEAR_REFS}", "near", "nrefs", tokenizer="whitespace"))
def q_u1(spark, d):
    """A user-registered tokenizer (whitespace split) plugged into BLEU."""
    return fmt_bleu(B.corpus_bleu(I.near(spark, d), tokenizer="user_whitespace"))


# ============================================================ encoding (E)
VOCAB_K = 1000
BLOCK = 64


def _vocab(spark, d, specials=E.SPECIAL_TOKENS, k=VOCAB_K):
    return E.build_vocabulary(I.table(spark, d, "documents"), "text", k, lower=True, specials=specials)


def _vocab_sql(specials=E.SPECIAL_TOKENS, k=VOCAB_K) -> str:
    sp = " UNION ALL ".join(f"SELECT '{t}' AS token, {i} AS id, true AS special, CAST(NULL AS BIGINT) AS freq" for t, i in specials)
    base = max(i for _, i in specials) + 1
    names = ", ".join(f"'{t}'" for t, _ in specials)
    return f"""words AS (SELECT unnest({S.tok_t1('lower(text)')}) AS token FROM documents),
counts AS (SELECT token, count(*) AS freq FROM words WHERE token NOT IN ({names}) GROUP BY token),
top AS (SELECT token, freq FROM counts ORDER BY freq DESC, token ASC LIMIT {k}),
vocab AS ({sp} UNION ALL
  SELECT token, CAST(row_number() OVER (ORDER BY freq DESC, token ASC) - 1 + {base} AS INTEGER), false, freq FROM top)"""


@register("e1_vocabulary", f"WITH {_vocab_sql()}\nSELECT token, CAST(id AS INTEGER) AS id, special, CAST(freq AS BIGINT) AS freq FROM vocab")
def q_e1(spark, d):
    """Frequency-ranked vocabulary (top 1000, lower-cased) after the specials."""
    return _vocab(spark, d).select("token", F.col("id").cast("int").alias("id"), "special", F.col("freq").cast("long").alias("freq"))


_ENC_SQL = f"""{_vocab_sql()},
toks AS (SELECT doc_id, unnest({S.tok_t1('lower(text)')}) AS token, generate_subscripts({S.tok_t1('lower(text)')}, 1) AS pos FROM documents),
enc AS (SELECT d.doc_id, coalesce(list(coalesce(v.id, 2) ORDER BY t.pos) FILTER (WHERE t.pos IS NOT NULL), []) AS ids
        FROM documents d LEFT JOIN toks t USING (doc_id) LEFT JOIN vocab v ON v.token = t.token GROUP BY d.doc_id)"""


@register(
    "e2_encode",
    f"""WITH {_ENC_SQL}
SELECT doc_id AS id, CAST(len(ids) AS BIGINT) AS n_ids, CAST(len(list_filter(ids, lambda x: x = 2)) AS BIGINT) AS n_unk,
       md5(array_to_string(ids, ' ')) AS digest FROM enc""",
)
def q_e2(spark, d):
    """Every document encoded to vocabulary ids (unknown -> 2)."""
    enc = E.encode(I.table(spark, d, "documents"), "doc_id", "text", _vocab(spark, d), lower=True)
    return enc.select(
        F.col("doc_id").alias("id"),
        F.size("input_ids").cast("long").alias("n_ids"),
        F.size(F.filter("input_ids", lambda x: x == 2)).cast("long").alias("n_unk"),
        digest(F.col("input_ids")).alias("digest"),
    )


@register(
    "e3_truncate_pad",
    f"""WITH {_ENC_SQL},
blk AS (SELECT doc_id, ids[1:{BLOCK}] AS body FROM enc)
SELECT doc_id AS id,
       md5(array_to_string(list_concat(body, list_transform(range({BLOCK} - len(body)), lambda x: 0)), ' ')) AS ids_digest,
       CAST(len(body) AS BIGINT) AS mask_sum
FROM blk""",
)
def q_e3(spark, d):
    """Cut to a block of 64 and pad with 0; the mask marks real positions."""
    enc = E.encode(I.table(spark, d, "documents"), "doc_id", "text", _vocab(spark, d), lower=True)
    return enc.select(
        F.col("doc_id").alias("id"),
        digest(truncate_pad("input_ids", BLOCK, 0)).alias("ids_digest"),
        F.aggregate(attention_mask("input_ids", BLOCK), F.lit(0).cast("long"), lambda a, x: a + x).alias("mask_sum"),
    )


_NOPAD = [("</s>", 1), ("<unk>", 2)]


@register(
    "e4_pad_fallback",
    f"""WITH {_vocab_sql(_NOPAD)}
SELECT coalesce(max(token) FILTER (WHERE token = '<pad>'), max(token) FILTER (WHERE token = '</s>')) AS pad_token,
       CAST(coalesce(max(id) FILTER (WHERE token = '<pad>'), max(id) FILTER (WHERE token = '</s>')) AS INTEGER) AS pad_id,
       CAST(count(*) AS BIGINT) AS vocab_size
FROM vocab""",
)
def q_e4(spark, d):
    """A vocabulary without a pad token pads with the end token."""
    v = _vocab(spark, d, _NOPAD)
    return E.resolve_pad(v).select("pad_token", F.col("pad_id").cast("int").alias("pad_id"), F.col("vocab_size").cast("long").alias("vocab_size"))


_HALF_SQL = """halves AS (
  SELECT doc_id, array_to_string(w[1:len(w) // 2], ' ') AS code, array_to_string(w[len(w) // 2 + 1:len(w)], ' ') AS doc
  FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))"""


def _halves(spark, d):
    docs = I.table(spark, d, "documents")
    w = F.split("text", " ")
    half = (F.size(w) / 2).cast("int")
    return docs.select(
        "doc_id",
        F.array_join(F.slice(w, F.lit(1), half), " ").alias("code"),
        F.array_join(F.slice(w, half + 1, F.size(w)), " ").alias("doc"),
    )


def _enc_side_sql(col: str, name: str) -> str:
    t = S.tok_t1(f"lower({col})")
    return f"""{name}_t AS (SELECT doc_id, unnest({t}) AS token, generate_subscripts({t}, 1) AS pos FROM halves),
{name} AS (SELECT h.doc_id, coalesce(list(coalesce(v.id, 2) ORDER BY t.pos) FILTER (WHERE t.pos IS NOT NULL), []) AS ids
        FROM halves h LEFT JOIN {name}_t t USING (doc_id) LEFT JOIN vocab v ON v.token = t.token GROUP BY h.doc_id)"""


E5_BLOCK = 32


@register(
    "e5_encoded_pairs",
    f"""WITH {_vocab_sql()}, {_HALF_SQL}, {_enc_side_sql('code', 'ce')}, {_enc_side_sql('doc', 'de')}
SELECT ce.doc_id AS id,
  md5(array_to_string(list_concat(ce.ids[1:{E5_BLOCK}], list_transform(range({E5_BLOCK} - len(ce.ids[1:{E5_BLOCK}])), lambda x: 0)), ' ')) AS input_ids,
  CAST(least(len(ce.ids), {E5_BLOCK}) AS BIGINT) AS code_mask_sum,
  md5(array_to_string(list_concat(de.ids[1:{E5_BLOCK}], list_transform(range({E5_BLOCK} - len(de.ids[1:{E5_BLOCK}])), lambda x: 0)), ' ')) AS target_ids,
  CAST(least(len(de.ids), {E5_BLOCK}) AS BIGINT) AS docs_mask_sum
FROM ce JOIN de USING (doc_id)""",
)
def q_e5(spark, d):
    """E5 + P2: encoded pair layout (input_ids, code_attention_mask, target_ids,
    docs_attention_mask); code = first half of a document's words, comment = rest."""
    enc = E.encode_pairs(_halves(spark, d), "doc_id", "code", "doc", _vocab(spark, d), E5_BLOCK, lower=True)

    def msum(c):
        return F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)

    return enc.select(
        F.col("doc_id").alias("id"),
        digest(F.col("input_ids")).alias("input_ids"),
        msum(F.col("code_attention_mask")).alias("code_mask_sum"),
        digest(F.col("target_ids")).alias("target_ids"),
        msum(F.col("docs_attention_mask")).alias("docs_mask_sum"),
    )


@register(
    "e6_decode",
    f"""WITH {_ENC_SQL},
dec AS (SELECT e.doc_id, coalesce(string_agg(v.token, ' ' ORDER BY p.pos) FILTER (WHERE NOT v.special), '') AS text
        FROM enc e LEFT JOIN (SELECT doc_id, unnest(ids) AS tid, generate_subscripts(ids, 1) AS pos FROM enc) p USING (doc_id)
        LEFT JOIN vocab v ON v.id = p.tid GROUP BY e.doc_id)
SELECT doc_id AS id, md5(text) AS digest, CAST(length(text) AS BIGINT) AS n_chars FROM dec""",
)
def q_e6(spark, d):
    """Decode the encoded documents back to text, skipping special ids."""
    v = _vocab(spark, d)
    enc = E.encode(I.table(spark, d, "documents"), "doc_id", "text", v, lower=True)
    dec = E.decode(enc, "doc_id", "input_ids", v)
    return dec.select(F.col("doc_id").alias("id"), F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


@register(
    "e7_argmax",
    f"""WITH {I.LOGITS_SQL}
SELECT id, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS prediction, target,
       CAST(list_position(logits, list_max(logits)) - 1 = target AS BOOLEAN) AS correct FROM logits""",
)
def q_e7(spark, d):
    """Argmax over the last axis (lowest index on ties)."""
    lg = I.logits(spark, d)
    return lg.select("id", argmax("logits").alias("prediction"), "target", (argmax("logits") == F.col("target")).alias("correct"))


@register(
    "e8_pad_batches",
    f"""WITH {_ENC_SQL},
b AS (SELECT doc_id, ids, floor((row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR))) - 1) / 16) AS batch_id FROM enc)
SELECT doc_id AS id, CAST(max(len(ids)) OVER (PARTITION BY batch_id) AS BIGINT) AS padded_len,
       CAST(len(ids) AS BIGINT) AS n_ids FROM b""",
)
def q_e8(spark, d):
    """Pad each batch of 16 to its longest row."""
    enc = E.encode(I.table(spark, d, "documents"), "doc_id", "text", _vocab(spark, d), lower=True)
    b = BT.assign_batches(enc, "doc_id", 16, seed=42)
    padded = E.pad_batches(b, "batch_id", "input_ids", 0, "padded")
    return padded.select(
        F.col("doc_id").alias("id"), F.size("padded").cast("long").alias("padded_len"), F.size("input_ids").cast("long").alias("n_ids")
    )


@register(
    "e9_batches",
    """SELECT doc_id AS id, CAST(row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR))) AS BIGINT) AS position,
       CAST(floor((row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR))) - 1) / 64) AS BIGINT) AS batch_id
FROM documents""",
)
def q_e9(spark, d):
    """Seeded shuffle (seed 42) and batches of 64."""
    docs = I.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return BT.assign_batches(docs, "id", 64, shuffle=True, seed=42).select("id", "position", "batch_id")


@register(
    "e10_epoch_plan",
    f"""SELECT split, CAST(count(*) AS BIGINT) AS rows, CAST(ceil(count(*) / 64) AS BIGINT) AS steps_per_epoch,
       CAST(ceil(count(*) / 64) * 5 AS BIGINT) AS total_steps, CAST(ceil(count(*) / 64) * 64 AS BIGINT) AS nominal_examples
FROM (SELECT {I.split_sql('doc_id')} AS split FROM documents) GROUP BY split""",
)
def q_e10(spark, d):
    """Batches per epoch, total steps over 5 epochs, nominal examples."""
    docs = I.table(spark, d, "documents").withColumn("split", I.split_of("doc_id"))
    return BT.epoch_plan(docs, 64, 5).select(
        "split", F.col("rows").cast("long").alias("rows"), "steps_per_epoch", "total_steps", "nominal_examples"
    )


# ============================================== evaluation loop
SEQ_LEN = 8
EVAL_BATCH = 8
_EVAL_SQL = f"""WITH {_vocab_sql(k=61)},
pos AS (SELECT vec_id // {SEQ_LEN} AS seq_id, vec_id % {SEQ_LEN} AS pos, embedding AS logits, label AS target FROM embeddings),
lossrows AS (SELECT seq_id, pos, target, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred_id,
                    list_max(list_transform(logits, lambda x: CAST(x AS DOUBLE))) AS m,
                    list_transform(logits, lambda x: CAST(x AS DOUBLE)) AS l FROM pos),
scored AS (SELECT seq_id, pos, target, pred_id,
                  CASE WHEN target <> 0 THEN m + ln(list_sum(list_transform(l, lambda x: exp(x - m)))) - l[target + 1] END AS loss
           FROM lossrows),
seqs AS (SELECT seq_id, CAST((dense_rank() OVER (ORDER BY seq_id) - 1) // {EVAL_BATCH} AS BIGINT) AS batch_id
         FROM (SELECT DISTINCT seq_id FROM scored)),
gen AS (SELECT s.seq_id, coalesce(string_agg(v.token, ' ' ORDER BY s.pos) FILTER (WHERE NOT v.special), '') AS pred
        FROM scored s LEFT JOIN vocab v ON v.id = s.pred_id GROUP BY s.seq_id),
act AS (SELECT s.seq_id, coalesce(string_agg(v.token, ' ' ORDER BY s.pos) FILTER (WHERE NOT v.special), '') AS ref
        FROM scored s LEFT JOIN vocab v ON v.id = s.target GROUP BY s.seq_id),
epairs AS (SELECT g.seq_id AS id, q.batch_id, g.pred, a.ref FROM gen g JOIN act a USING (seq_id) JOIN seqs q USING (seq_id)),
erefs AS (SELECT id, 0 AS ref_no, ref FROM epairs),
{S.bleu_ctes("bl0 AS (SELECT 1)", "epairs", "erefs", group_cols=["batch_id"], smooth=True, weight=2).replace("bl0 AS (SELECT 1),", "", 1)},
em AS (SELECT batch_id, avg(CASE WHEN lower(pred) = lower(ref) THEN 1.0 ELSE 0.0 END) AS em FROM epairs GROUP BY batch_id),
bloss AS (SELECT q.batch_id, avg(s.loss) AS loss FROM scored s JOIN seqs q USING (seq_id) GROUP BY q.batch_id)
SELECT round(avg(loss), 6) AS eval_loss, round(coalesce(avg(geo * bp), 0.0), 6) AS eval_bleu_score,
       round(coalesce(avg(em), 0.0), 6) AS eval_EM_score, CAST(count(*) AS BIGINT) AS batches
FROM bloss FULL JOIN em USING (batch_id) LEFT JOIN fin USING (batch_id)"""


@register("a7_evaluate_batches", _EVAL_SQL)
def q_evaluate(spark, d):
    """The evaluation loop: embeddings read as 8-position sequences of logits
    (label = target id), argmax predictions and targets decoded through a
    64-entry vocabulary, then per batch of 8 sequences: smoothed BLEU with
    pairs counted twice, exact match and masked loss; means over batches."""
    emb = I.table(spark, d, "embeddings")
    positions = emb.select(
        F.floor(F.col("vec_id") / SEQ_LEN).cast("long").alias("seq_id"),
        (F.col("vec_id") % SEQ_LEN).cast("int").alias("pos"),
        F.col("embedding").alias("logits"),
        F.col("label").alias("target"),
    )
    out = EV.evaluate(positions, _vocab(spark, d, k=61), EVAL_BATCH)
    return out.select(
        F.round("eval_loss", 6).alias("eval_loss"),
        F.round("eval_bleu_score", 6).alias("eval_bleu_score"),
        F.round("eval_EM_score", 6).alias("eval_EM_score"),
        F.col("batches").cast("long").alias("batches"),
    )


# ================================================================ U2
@register(
    "u2_batch_prediction",
    f"""WITH {I.LOGITS_SQL}
SELECT id, CAST(target AS VARCHAR) AS actual_comments,
       CAST(list_position(logits, list_max(logits)) - 1 AS VARCHAR) AS generated_comments FROM logits""",
)
def q_u2(spark, d):
    """A pluggable predictor (argmax of stored logits) run batch by batch in
    Python workers; output (id, actual, generated)."""
    lg = I.logits(spark, d)
    out = predict_batches(lg, argmax_predictor("logits"), "id", ["logits"], out_col="pred", out_type="int", batch_size=4, pass_cols=["target"])
    return out.select(
        "id", F.col("target").cast("string").alias("actual_comments"), F.col("pred").cast("string").alias("generated_comments")
    )


# ==================================================== test flow (S1 ... S4)
FLOW_SPECIALS = [("<pad>", 0), ("</s>", 1), ("<unk>", 2), ("<s>", 3)]
FLOW_IDS = VOCAB_K + len(FLOW_SPECIALS)


def id_map_predictor(vocab_size: int):
    """Stands in for a model: each real position's id mapped to another, padding kept."""

    def factory():
        def predict(pdf: pd.DataFrame) -> pd.Series:
            pairs = zip(pdf["input_ids"], pdf["code_attention_mask"], strict=True)
            return pd.Series([((ids * 7 + 5) % vocab_size * mask).astype("int32") for ids, mask in pairs], index=pdf.index)

        return predict

    return factory


def _flow_text_sql(name: str, ids: str, source: str) -> str:
    return f"""{name}_p AS (SELECT doc_id, unnest({ids}) AS tid, generate_subscripts({ids}, 1) AS pos FROM {source}),
{name} AS (SELECT s.doc_id, coalesce(string_agg(v.token, ' ' ORDER BY p.pos) FILTER (WHERE NOT v.special), '') AS text
        FROM {source} s LEFT JOIN {name}_p p USING (doc_id) LEFT JOIN vocab v ON v.id = p.tid GROUP BY s.doc_id)"""


_FLOW_INPUT = f"list_concat([3], ids[1:{E5_BLOCK - 2}], [1])"


@register(
    "flow_test_predictions",
    f"""WITH {_vocab_sql(specials=FLOW_SPECIALS)}, {_HALF_SQL}, {_enc_side_sql('code', 'ce')}, {_enc_side_sql('doc', 'de')},
{_flow_text_sql('act', f'ids[1:{E5_BLOCK - 2}]', 'de')},
{_flow_text_sql('gen', f'list_transform({_FLOW_INPUT}, lambda x: (x * 7 + 5) % {FLOW_IDS})', 'ce')}
SELECT a.doc_id AS id, md5(a.text) AS actual_digest, md5(g.text) AS generated_digest, CAST(length(g.text) AS BIGINT) AS generated_chars
FROM act a JOIN gen g USING (doc_id)""",
)
def q_flow(spark, d):
    """The test run as one plan: JSON Lines records (S1) of token arrays are joined
    (P1), shuffled into batches (E9), encoded with start and end id (E5), predicted
    (U2), decoded (E6) and written as the prediction CSV (S4), which is read back."""
    halves = _halves(spark, d)
    records = halves.select(F.col("doc_id").alias("id"), words_and_symbols("code").alias("code_tokens"), words_and_symbols("doc").alias("docstring_tokens"))
    source, target = scratch_path(spark, "flow-records"), scratch_path(spark, "flow-csv")
    IO.write_jsonl(records, source)
    read = IO.read_jsonl(spark, source, "id long, code_tokens array<string>, docstring_tokens array<string>")
    texts = FL.predict_test_set(
        read, _vocab(spark, d, specials=FLOW_SPECIALS), id_map_predictor(FLOW_IDS), E5_BLOCK, batch_size=4, lower=True, bos_id=3, eos_id=1
    )
    IO.write_predictions_csv(texts, target)
    back = IO.read_predictions_csv(spark, target)
    return back.select(
        "id", F.md5("actual_comments").alias("actual_digest"), F.md5("generated_comments").alias("generated_digest"),
        F.length("generated_comments").cast("long").alias("generated_chars"),
    )


# ============================================================ checks
@register(
    "w1_sorted_events",
    """SELECT CAST(count(*) FILTER (WHERE p > ts) = 0 AS BOOLEAN) AS sorted, CAST(count(*) AS BIGINT) AS rows,
       CAST(count(*) FILTER (WHERE p > ts) AS BIGINT) AS violations, min(event_id) FILTER (WHERE p > ts) AS first_violation_pos
FROM (SELECT event_id, ts, lag(ts) OVER (ORDER BY event_id) AS p FROM events)""",
)
def q_w1_events(spark, d):
    """Events in event_id order are sorted by time."""
    ev = I.table(spark, d, "events")
    return C.sorted_by_date(ev, "event_id", "ts").select("sorted", "rows", "violations", "first_violation_pos")


@register(
    "w1_sorted_orders",
    """SELECT CAST(count(*) FILTER (WHERE p > o_orderdate) = 0 AS BOOLEAN) AS sorted, CAST(count(*) AS BIGINT) AS rows,
       CAST(count(*) FILTER (WHERE p > o_orderdate) AS BIGINT) AS violations,
       min(o_orderkey) FILTER (WHERE p > o_orderdate) AS first_violation_pos
FROM (SELECT o_orderkey, o_orderdate, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS p FROM orders)""",
)
def q_w1_orders(spark, d):
    """Orders in key order are not sorted by date."""
    o = I.table(spark, d, "orders")
    return C.sorted_by_date(o, "o_orderkey", "o_orderdate").select("sorted", "rows", "violations", "first_violation_pos")


def _leak_sql(table: str, pos: str, date: str, split_expr: str) -> str:
    return f"""WITH x AS (SELECT {pos} AS pos, {date} AS dt, {split_expr} AS split FROM {table}),
s AS (SELECT split, count(*) FILTER (WHERE p > dt) AS v, arg_min(dt, pos) AS first_dt, arg_max(dt, pos) AS last_dt
      FROM (SELECT *, lag(dt) OVER (PARTITION BY split ORDER BY pos) AS p FROM x) GROUP BY split),
o AS (SELECT max(v) FILTER (WHERE split = 'train') AS tv, max(v) FILTER (WHERE split = 'test') AS sv,
             max(last_dt) FILTER (WHERE split = 'train') AS tl, max(first_dt) FILTER (WHERE split = 'test') AS sf FROM s)
SELECT CASE WHEN tv > 0 THEN 'train_unsorted' WHEN sv > 0 THEN 'test_unsorted' WHEN tl > sf THEN 'leak' ELSE 'ok' END = 'ok' AS ok,
       CASE WHEN tv > 0 THEN 'train_unsorted' WHEN sv > 0 THEN 'test_unsorted' WHEN tl > sf THEN 'leak' ELSE 'ok' END AS reason,
       CAST(tv AS BIGINT) AS train_violations, CAST(sv AS BIGINT) AS test_violations,
       epoch_us(tl) AS train_last_us, epoch_us(sf) AS test_first_us FROM o"""


def _leak(df, pos, date, split_col="split"):
    r = C.leak_check(df, pos, date, split_col)
    dt = r.schema["train_last_date"].dataType
    return r.select(
        "ok", "reason", "train_violations", "test_violations",
        epoch_micros(F.col("train_last_date"), dt).alias("train_last_us"),
        epoch_micros(F.col("test_first_date"), dt).alias("test_first_us"),
    )


@register("w2_leak_events", _leak_sql("events", "event_id", "ts", "CASE WHEN ts < TIMESTAMP '2024-01-25' THEN 'train' ELSE 'test' END"))
def q_w2_events(spark, d):
    """Events split in time (train before 2024-01-25): no leak."""
    ev = I.table(spark, d, "events")
    cutoff = F.lit("2024-01-25 00:00:00").cast(ev.schema["ts"].dataType)
    ev = ev.withColumn("split", F.when(F.col("ts") < cutoff, "train").otherwise("test"))
    return _leak(ev, "event_id", "ts")


@register("w2_leak_orders", _leak_sql("orders", "o_orderkey", "o_orderdate", "CASE WHEN o_orderstatus = 'F' THEN 'train' ELSE 'test' END"))
def q_w2_orders(spark, d):
    """Orders split by status: the train split is not sorted by date."""
    o = I.table(spark, d, "orders").withColumn("split", F.when(F.col("o_orderstatus") == "F", "train").otherwise("test"))
    return _leak(o, "o_orderkey", "o_orderdate")


# ============================================================ run log
@register(
    "w3_running_loss",
    f"""WITH {I.RUNLOG_SQL}
SELECT run, epoch, CAST(step AS BIGINT) AS step,
       {I.exact_mean5_sql(f"sum({I.CENTS_SQL}) OVER w", "count(*) OVER w")} AS avg_loss
FROM steps WINDOW w AS (PARTITION BY run, epoch ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def q_w3(spark, d):
    """Running mean loss inside each epoch."""
    steps = I.exact_loss(I.runlog_steps(spark, d))
    return R.running_loss(steps).select("run", "epoch", "step", F.col("avg_loss").cast("double").alias("avg_loss"))


@register(
    "w4_interval_perplexity",
    f"""WITH {I.RUNLOG_SQL}
SELECT run, CAST(step AS BIGINT) AS step,
       round(exp(avg(loss) OVER (PARTITION BY run, (step - 1) // 10 ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 4) AS perplexity
FROM steps""",
)
def q_w4(spark, d):
    """exp(mean loss since the last logging boundary), logging every 10 steps."""
    s = I.runlog_steps(spark, d).withColumnRenamed("step", "global_step")
    return R.interval_perplexity(s, 10).select("run", F.col("global_step").alias("step"), "perplexity")


_PROGRESS_SQL = f"""{I.RUNLOG_SQL},
fl AS (SELECT *, row_number() OVER w AS idx,
         bleu > greatest(0.0, coalesce(max(bleu) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS best_bleu,
         em > greatest(0.0, coalesce(max(em) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS best_em
       FROM epochs WINDOW w AS (PARTITION BY run ORDER BY epoch)),
rs AS (SELECT *, last(CASE WHEN best_bleu OR best_em THEN idx END IGNORE NULLS) OVER w2 AS r_idx,
              last(CASE WHEN best_bleu OR best_em THEN best_em END IGNORE NULLS) OVER w2 AS r_em
       FROM fl WINDOW w2 AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pt AS (SELECT *, CAST(CASE WHEN r_idx IS NULL THEN 2 * idx ELSE (CASE WHEN r_em THEN 0 ELSE 1 END) + 2 * (idx - r_idx) END AS INTEGER) AS patience FROM rs),
pg AS (SELECT *, min(CASE WHEN patience = 6 THEN epoch END) OVER (PARTITION BY run) AS stop_epoch FROM pt)"""


def _progress(spark, d):
    return R.epoch_progress(I.runlog_epochs(spark, d), max_patience=6)


@register(
    "w5_best_so_far",
    f"""WITH {_PROGRESS_SQL}
SELECT run, epoch, round(bleu, 6) AS bleu, round(em, 6) AS em, best_bleu, best_em, (idx - 1) = 9 AS milestone FROM pg""",
)
def q_w5(spark, d):
    """Strict best-so-far flags for BLEU and exact match, plus the epoch-10 milestone."""
    p = _progress(spark, d)
    return p.select("run", "epoch", F.round("bleu", 6).alias("bleu"), F.round("em", 6).alias("em"), "best_bleu", "best_em", "milestone")


@register("w6_patience", f"WITH {_PROGRESS_SQL}\nSELECT run, epoch, patience, stop_epoch FROM pg")
def q_w6(spark, d):
    """Patience (closed form) and the early-stop epoch at patience == 6."""
    return _progress(spark, d).select("run", "epoch", "patience", "stop_epoch")


@register(
    "w7_best_epochs",
    f"""WITH {_PROGRESS_SQL},
live AS (SELECT * FROM pg WHERE stop_epoch IS NULL OR epoch <= stop_epoch)
SELECT run, coalesce(max(epoch) FILTER (WHERE best_bleu), max(stop_epoch)) AS best_bleu_epoch,
       max(epoch) FILTER (WHERE best_em) AS best_em_epoch, max(stop_epoch) AS stop_epoch, max(epoch) AS last_epoch
FROM live GROUP BY run""",
)
def q_w7(spark, d):
    """Best epoch per run and metric, up to the stop epoch."""
    return R.best_epochs(_progress(spark, d))


@register(
    "w8_global_steps",
    f"""WITH {I.RUNLOG_SQL}
SELECT run, epoch, CAST(step - epoch * 25 AS BIGINT) AS step_in_epoch,
       CAST(row_number() OVER (PARTITION BY run ORDER BY epoch, step - epoch * 25) AS BIGINT) AS global_step
FROM steps""",
)
def q_w8(spark, d):
    """Step numbering across epochs from (epoch, step in epoch)."""
    s = I.runlog_steps(spark, d).select("run", "epoch", (F.col("step") - F.col("epoch") * 25).cast("long").alias("step_in_epoch"))
    return R.global_steps(s, step_col="step_in_epoch").select("run", "epoch", "step_in_epoch", "global_step")


# ============================================================ P1-P4
@register(
    "p1_join_tokens",
    f"""SELECT doc_id AS id, md5(array_to_string({S.tok_t1('text')}, ' ')) AS digest,
       CAST(length(array_to_string({S.tok_t1('text')}, ' ')) AS BIGINT) AS n_chars FROM documents""",
)
def q_p1(spark, d):
    """Token arrays joined with one space (null tokens would fail the job)."""
    docs = I.table(spark, d, "documents").select("doc_id", words_and_symbols("text").alias("t"))
    joined = join_tokens("t")
    return docs.select(F.col("doc_id").alias("id"), F.md5(joined).alias("digest"), F.length(joined).cast("long").alias("n_chars"))


@register("p3_head", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 50")
def q_p3(spark, d):
    """The first 50 records in id order (a top-n; the limit is the feature)."""
    return IO.head(I.table(spark, d, "documents").select("doc_id", "lang", "n_chars"), 50, ["doc_id"])


@register(
    "p4_split_counts",
    f"SELECT split, CAST(count(*) AS BIGINT) AS rows FROM (SELECT {I.split_sql('doc_id')} AS split FROM documents) GROUP BY split",
)
def q_p4(spark, d):
    """Rows per split."""
    docs = I.table(spark, d, "documents").withColumn("split", I.split_of("doc_id"))
    return IO.split_counts(docs).select("split", F.col("rows").cast("long").alias("rows"))


# ============================================================ S1-S6
@register("s1_s2_jsonl_roundtrip", "SELECT conv_id, turn, role, text FROM conversations")
def q_s1(spark, d):
    """S2 then S1: conversations written as JSON Lines and read back with a schema."""
    path = scratch_path(spark, "jsonl")
    IO.write_jsonl(I.table(spark, d, "conversations"), path)
    return IO.read_jsonl(spark, path, "conv_id long, turn long, role string, text string")


@register(
    "s1_review_records_strict",
    """SELECT doc_id, md5(array_to_string(w[1:len(w) // 2], ' ')) AS code_digest,
       md5(array_to_string(w[len(w) // 2 + 1:len(w)], ' ')) AS docstring_digest, CAST(len(w) AS BIGINT) AS n_tokens
FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""",
)
def q_s1_review(spark, d):
    """S2 -> S1 (strict blank-line rule) -> P1: documents written as review
    records (first half of the words as code tokens, the rest as docstring
    tokens), loaded back with an explicit schema and joined to text."""
    docs = I.table(spark, d, "documents")
    w = F.split("text", " ")
    half = (F.size(w) / 2).cast("int")
    records = docs.select(
        "doc_id", F.slice(w, F.lit(1), half).alias("code_tokens"), F.slice(w, half + 1, F.size(w)).alias("docstring_tokens")
    )
    path = scratch_path(spark, "review-jsonl")
    IO.write_jsonl(records, path)
    back = IO.read_jsonl_strict(spark, path, "doc_id long, code_tokens array<string>, docstring_tokens array<string>")
    n = (F.size("code_tokens") + F.size("docstring_tokens")).cast("long")
    joined = IO.join_token_columns(back.withColumn("n_tokens", n))
    return joined.select(
        "doc_id", F.md5("code_tokens").alias("code_digest"), F.md5("docstring_tokens").alias("docstring_digest"), "n_tokens"
    )


@register(
    "s3_split_sources",
    f"""SELECT split, CAST(count(*) AS BIGINT) AS rows, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(n_tokens) AS BIGINT) AS tokens
FROM (SELECT {I.split_sql('doc_id')} AS split, n_chars, len({S.tok_t1('text')}) AS n_tokens FROM documents) GROUP BY split""",
)
def q_s3(spark, d):
    """S3: documents written as one JSONL file set per split, loaded back as
    labelled splits and unioned."""
    docs = I.table(spark, d, "documents").select(
        "doc_id", "n_chars", words_and_symbols("text").alias("code_tokens"), I.split_of("doc_id").alias("split")
    )
    root = scratch_path(spark, "splits")
    IO.write_splits(docs, root, fmt="json")
    paths = {s: f"{root}/split={s}" for s in ("train", "validation", "test")}
    back = IO.read_splits(spark, paths, "doc_id long, n_chars long, code_tokens array<string>")
    return back.groupBy("split").agg(
        F.count(F.lit(1)).cast("long").alias("rows"),
        F.sum("n_chars").cast("long").alias("chars"),
        F.sum(F.size("code_tokens")).cast("long").alias("tokens"),
    )


@register(
    "s4_csv_roundtrip",
    f"WITH {I.PAIRS_SQL}\nSELECT id, md5(ref) AS actual_digest, md5(pred) AS generated_digest FROM pairs",
)
def q_s4(spark, d):
    """Prediction table written as CSV with a header and read back; texts
    with newlines, quotes and edge spaces survive."""
    p = I.pairs(spark, d).select("id", F.col("ref").alias("actual_comments"), F.col("pred").alias("generated_comments"))
    path = scratch_path(spark, "csv")
    IO.write_predictions_csv(p, path)
    back = IO.read_predictions_csv(spark, path)
    return back.select("id", F.md5("actual_comments").alias("actual_digest"), F.md5("generated_comments").alias("generated_digest"))


@register(
    "s5_materialized_encoding",
    f"""WITH {_ENC_SQL}
SELECT doc_id AS id, CAST(len(ids) AS BIGINT) AS n_ids, md5(array_to_string(ids, ' ')) AS digest FROM enc""",
)
def q_s5(spark, d):
    """The encoded set is written once under a fingerprint of its parameters
    and input schema; a second call loads it instead of recomputing."""
    docs = I.table(spark, d, "documents")
    params = {"op": "encode", "sf_dir": d, "k": VOCAB_K, "lower": True, "tokenizer": "words_and_symbols"}
    base = scratch_path(spark, "materialized")

    def build():
        return E.encode(docs, "doc_id", "text", _vocab(spark, d), lower=True)

    IO.materialize(spark, base, params, build, source=docs)
    enc = IO.materialize(spark, base, params, build, source=docs)
    return enc.select(F.col("doc_id").alias("id"), F.size("input_ids").cast("long").alias("n_ids"), digest(F.col("input_ids")).alias("digest"))


@register(
    "s6_metric_log",
    f"""WITH {I.RUNLOG_SQL}
SELECT CAST(run AS VARCHAR) AS run, epoch, CAST(max(step) AS BIGINT) AS step, metric, round(value, 6) AS value
FROM (SELECT e.run, e.epoch, s.step, 'bleu' AS metric, e.bleu AS value FROM epochs e JOIN steps s USING (run, epoch)
      UNION ALL SELECT e.run, e.epoch, s.step, 'em', e.em FROM epochs e JOIN steps s USING (run, epoch))
GROUP BY run, epoch, metric, value""",
)
def q_s6(spark, d):
    """Per-epoch metrics appended to a Parquet metric log (by run) and read back."""
    steps = I.runlog_steps(spark, d)
    last_step = steps.groupBy("run", "epoch").agg(F.max("step").alias("step"))
    ep = I.runlog_epochs(spark, d).join(last_step, ["run", "epoch"])
    path = scratch_path(spark, "metric-log")
    IO.log_metrics(ep.select("run", "epoch", "step", "bleu", "em"), path)
    back = IO.read_metric_log(spark, path)
    return back.select("run", "epoch", "step", "metric", F.round("value", 6).alias("value"))


# ============================================================ ST1
def _fmt_with_em(scores: DataFrame) -> DataFrame:
    """BLEU columns as ``fmt_bleu`` plus the rounded exact match."""
    rounded = scores.withColumn("exact_match", F.round("exact_match", 6))
    return rounded.select(*_bleu_cols(), "exact_match")


def _bleu_cols(max_order: int = 4) -> list:
    return [
        F.round("bleu_score", 6).alias("bleu_score"),
        *[F.round(F.col("precisions")[k], 6).alias(f"precision_{k + 1}") for k in range(max_order)],
        F.round("brevity_penalty", 6).alias("brevity_penalty"),
        F.round("length_ratio", 6).alias("length_ratio"),
        F.col("translation_length").cast("long").alias("translation_length"),
        F.col("reference_length").cast("long").alias("reference_length"),
        F.col("pairs").cast("long").alias("pairs"),
    ]


@register(
    "st1_streaming_bleu",
    S.bleu_sql(
        f"{I.NEAR_SQL}, {NEAR_REFS}", "near", "nrefs",
        extra_select=", round((SELECT avg(CASE WHEN lower(pred) = lower(ref) THEN 1.0 ELSE 0.0 END) FROM near), 6) AS exact_match",
    ),
)
def q_st1(spark, d):
    """ST1: documents arrive as 8 files; BLEU and exact match are kept current per
    micro-batch from mergeable partial states, folded every second one; the final
    state equals batch scoring."""
    from textscore.streaming.evaluation import current_scores, start_stream

    near = I.near(spark, d).withColumn("chunk", F.col("id") % 8)
    src = scratch_path(spark, "stream-src")
    near.select("id", "pred", "ref").repartitionByRange(8, "id").write.parquet(src)
    state = scratch_path(spark, "stream-state")
    ckpt = scratch_path(spark, "stream-ckpt")
    q = start_stream(spark, src, state, ckpt, max_files_per_trigger=2, compact_every=2)
    q.awaitTermination()
    scores = current_scores(spark, state)
    return _fmt_with_em(scores)
