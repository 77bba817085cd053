"""Corpus BLEU as a Spark plan.

Layouts accepted:

* **row pairs**: one row holds ``id``, the prediction and one reference string.
  The rows are spread by a hash of their content (one shuffle of raw text), and
  n-grams are counted and clipped within the row (see ``clip``).  Only the tiny
  per-group sums shuffle afterwards.
* **long references**: predictions ``(id, pred)`` and references ``(id, ref)``
  with any number of reference rows per id, or a row whose ``ref`` column is an
  ``array<string>``.  One id may own a large share of all references, so
  nothing is co-located on ``id``: segment n-gram counts are aggregated on
  ``(id, side, n, gram)`` and merged on ``(id, n, gram)``, both with map-side
  partial aggregation, so a hot id is spread over its grams.

In the long form every segment contributes one marker row (``n = 0``) carrying its token length, so
lengths, brevity and empty segments come out of the same pass as the grams
(the text is tokenized once).

The output of :func:`bleu_components` is the mergeable state of the metric
(A13): per group the pair count, both lengths and the per-order match and
possible counts.  Summing component rows and calling :func:`bleu_finalize` gives
the same result as scoring everything at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textscore.functions.text import explode_ngrams, gram_key_is_string, get_tokenizer, with_ngram_levels
from textscore.operators.clip import pair_counts
from textscore.operators.partitioning import cluster_rows, partition_count

Tokenizer = str | Callable[[Column], Column]

COMPONENT_COLS = ["pairs", "translation_length", "reference_length", "matches", "possible"]
RESULT_COLS = [
    "bleu_score",
    "precisions",
    "brevity_penalty",
    "length_ratio",
    "translation_length",
    "reference_length",
]


def _explode_grams(df: DataFrame, keys: list[str], tokens: str, max_order: int, as_string: bool) -> DataFrame:
    """T5 + marker: rows (keys..., n, w, gram).  n = 0 is one row per segment whose
    weight is the token count; n >= 1 rows are grams with weight 1."""
    levels = with_ngram_levels(df.select(*keys, tokens), tokens, max_order, as_string, prefix="_g")
    empty_gram = F.lit("") if as_string else F.array().cast("array<string>")
    stacked = F.array(
        F.struct(F.lit(0).alias("n"), F.size(tokens).cast("long").alias("w"), F.array(empty_gram).alias("grams")),
        *[
            F.struct(F.lit(k).alias("n"), F.lit(1).cast("long").alias("w"), F.col(f"_g{k}").alias("grams"))
            for k in range(1, max_order + 1)
        ],
    )
    per_order = levels.select(*keys, F.inline(stacked))
    return per_order.select(*keys, "n", "w", F.explode("grams").alias("gram"))


def _order_sums(value: str, max_order: int) -> list[Column]:
    return [F.sum(F.when(F.col("n") == k, F.col(value))).alias(f"_{value}{k}") for k in range(1, max_order + 1)]


def _as_arrays(df: DataFrame, keys: list[str], max_order: int, extra: list[str]) -> DataFrame:
    m = F.array(*[F.coalesce(F.col(f"_clip{k}"), F.lit(0)).cast("long") for k in range(1, max_order + 1)])
    p = F.array(*[F.coalesce(F.col(f"_pc{k}"), F.lit(0)).cast("long") for k in range(1, max_order + 1)])
    return df.select(*keys, *extra, m.alias("matches"), p.alias("possible"))


def bleu_components(
    preds: DataFrame,
    refs: DataFrame | None = None,
    *,
    id_col: str = "id",
    pred_col: str = "pred",
    ref_col: str = "ref",
    group_cols: Sequence[str] = (),
    tokenizer: Tokenizer = "13a",
    max_order: int = 4,
) -> DataFrame:
    """Mergeable BLEU state per group.

    ``refs is None``: ``preds`` holds both texts per row (``ref_col`` string or
    ``array<string>``).  Otherwise ``refs`` is the long reference table keyed by
    ``id_col``; group columns are taken from ``preds``.  Ids without a
    prediction or without any reference are left out (inner pairing, J1).
    """
    keys = list(group_cols)
    tok = get_tokenizer(tokenizer)
    as_string = gram_key_is_string(tokenizer)

    if refs is None and isinstance(preds.schema[ref_col].dataType, T.StringType):
        return _row_pair_components(preds, id_col, pred_col, ref_col, keys, tok, max_order)

    if refs is None:  # array of references in the row: long form without a join
        pairs = preds
        preds = pairs.select(id_col, *keys, pred_col)
        refs = pairs.select(id_col, F.posexplode(ref_col).alias("_ref_no", ref_col))
    elif "_ref_no" not in refs.columns:
        refs = refs.withColumn("_ref_no", F.monotonically_increasing_id())

    segs = preds.select(
        F.col(id_col).alias("_id"), F.lit(-1).cast("long").alias("_side"), tok(F.col(pred_col)).alias("_tok")
    ).unionByName(
        refs.select(
            F.col(id_col).alias("_id"), F.col("_ref_no").cast("long").alias("_side"), tok(F.col(ref_col)).alias("_tok")
        )
    )
    grams = _explode_grams(segs, ["_id", "_side"], "_tok", max_order, as_string)
    # level 1: counts per segment (partial aggregation makes them map-side)
    seg_counts = grams.groupBy("_id", "_side", "n", "gram").agg(F.sum("w").alias("c"))
    # level 2: prediction count and the maximum / minimum over references
    merged = seg_counts.groupBy("_id", "n", "gram").agg(
        F.max(F.when(F.col("_side") < 0, F.col("c"))).alias("pc"),
        F.max(F.when(F.col("_side") >= 0, F.col("c"))).alias("rc"),
        F.min(F.when(F.col("_side") >= 0, F.col("c"))).alias("rmin"),
    )
    clipped = merged.select(
        "_id",
        "n",
        F.coalesce("pc", F.lit(0)).alias("pc"),
        F.least(F.coalesce("pc", F.lit(0)), F.coalesce("rc", F.lit(0))).alias("clip"),
        F.when(F.col("n") == 0, F.col("pc")).alias("tl"),
        F.when(F.col("n") == 0, F.col("rmin")).alias("rl"),
    )
    # level 3: one row per id (pairs without prediction or reference drop out)
    per_id = (
        clipped.groupBy("_id")
        .agg(F.max("tl").alias("tl"), F.max("rl").alias("rl"), *_order_sums("clip", max_order), *_order_sums("pc", max_order))
        .where(F.col("tl").isNotNull() & F.col("rl").isNotNull())
    )
    if keys:
        groups = preds.select(F.col(id_col).alias("_id"), *keys)
        per_id = per_id.join(groups, "_id")
    agg = per_id.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum("tl").cast("long").alias("translation_length"),
        F.sum("rl").cast("long").alias("reference_length"),
        *[F.sum(f"_clip{k}").alias(f"_clip{k}") for k in range(1, max_order + 1)],
        *[F.sum(f"_pc{k}").alias(f"_pc{k}") for k in range(1, max_order + 1)],
    )
    return _as_arrays(agg, keys, max_order, ["pairs", "translation_length", "reference_length"])


def _row_pair_components(pairs, id_col, pred_col, ref_col, keys, tok, max_order) -> DataFrame:
    # each pair is one row and clipped on its own, whatever ids others have; the one
    # exchange of raw pair rows spreads the work, after it only a row's sums move
    held = {f"_k{i}": F.col(k) for i, k in enumerate(keys)}
    own = F.xxhash64(F.col(id_col), F.col(pred_col), F.col(ref_col)).alias("_own")
    rows = cluster_rows(pairs.select(own, *(c.alias(k) for k, c in held.items()), pred_col, ref_col), "_own")
    toks = rows.select(*held, tok(F.col(pred_col)).alias("_p"), tok(F.col(ref_col)).alias("_r"))
    agg = pair_counts(toks, list(held), "_p", "_r", max_order).groupBy(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys))).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.coalesce(F.sum("_tl"), F.lit(0)).cast("long").alias("translation_length"),
        F.coalesce(F.sum("_rl"), F.lit(0)).cast("long").alias("reference_length"),
        *[F.sum(f"_{c}{k}").alias(f"_{c}{k}") for c in ("clip", "pc") for k in range(1, max_order + 1)],
    )
    return _as_arrays(agg, keys, max_order, ["pairs", "translation_length", "reference_length"])


def clipped_by_order(
    pairs: DataFrame, id_col: str = "id", pred_col: str = "pred", ref_col: str = "ref", tokenizer: Tokenizer = "13a", max_order: int = 4
) -> DataFrame:
    """J2 + A3 + A4 per order ``n``: ``matches`` (clipped), ``possible`` and
    ``shared_grams`` (distinct n-grams of a pair that both sides have).

    Rows that share an id are one pair, a null id among them.  An id of one row is
    counted within the row; the rows of the others are counted gram by gram, so that an
    id with any number of rows is spread over its grams.
    """
    tok, as_string = get_tokenizer(tokenizer), gram_key_is_string(tokenizer)
    rows = pairs.select(F.col(id_col).alias("_id"), pred_col, ref_col)
    repeated = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select(F.col("_id").alias("_rep"))
    same = rows["_id"].eqNullSafe(repeated["_rep"])

    single = rows.join(repeated, same, "left_anti").withColumn("_own", F.xxhash64("_id", pred_col, ref_col))
    single = cluster_rows(single, "_own").select(tok(F.col(pred_col)).alias("_p"), tok(F.col(ref_col)).alias("_r"))
    orders = range(1, max_order + 1)
    of_ref = [F.greatest(F.col("_rl") - (k - 1), F.lit(0)) for k in orders]
    sums = pair_counts(single, [], "_p", "_r", max_order).agg(
        *[F.sum(f"_{c}{k}").alias(f"_{c}{k}") for c in ("clip", "pc", "shared") for k in orders],
        *[F.sum(c).alias(f"_rc{k}") for k, c in zip(orders, of_ref, strict=True)],
    )
    per_order = [
        F.struct(F.lit(k).alias("n"), F.col(f"_clip{k}").alias("m"), F.col(f"_pc{k}").alias("p"), F.col(f"_shared{k}").alias("s"), F.col(f"_rc{k}").alias("r"))
        for k in orders
    ]
    within = sums.select(F.inline(F.array(*per_order))).where("p + r > 0").select("n", "m", "p", "s")

    segs = rows.join(repeated, same, "left_semi").select(
        "_id",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("_side"), tok(F.col(pred_col)).alias("_tok")),
                F.struct(F.lit(1).alias("_side"), tok(F.col(ref_col)).alias("_tok")),
            )
        ),
    )
    grams = explode_ngrams(segs, ["_id", "_side"], "_tok", max_order, as_string)
    cnt = grams.groupBy("_id", "n", "gram").agg(F.count(F.when(F.col("_side") == 0, 1)).alias("pc"), F.count(F.when(F.col("_side") == 1, 1)).alias("rc"))
    both = F.least("pc", "rc")
    across = cnt.groupBy("n").agg(F.sum(both).alias("m"), F.sum("pc").alias("p"), F.count(F.when(both > 0, 1)).alias("s"))
    return within.unionByName(across).groupBy("n").agg(
        F.sum("m").cast("long").alias("matches"), F.sum("p").cast("long").alias("possible"), F.sum("s").cast("long").alias("shared_grams")
    )


def reference_union(
    refs: DataFrame, id_col: str = "id", no_col: str = "_ref_no", ref_col: str = "ref", tokenizer: Tokenizer = "13a", max_order: int = 4, num_partitions: int | None = None
) -> DataFrame:
    """A2: ``(id, n, gram, c)``, per gram the largest count in any one reference.

    Rows that share id and number are one reference.  References are hash-partitioned
    as text and their grams counted there; the counts are dealt out by gram, so an id
    with very many references is spread.  With ``num_partitions`` by the size of the
    text neither step holds more when there are more references.
    """
    tok = get_tokenizer(tokenizer)
    n = partition_count(refs, num_partitions)
    rows = cluster_rows(refs.select(F.col(id_col).alias("id"), F.col(no_col).alias("_side"), ref_col), "id", "_side", num_partitions=n)
    segs = rows.select("id", "_side", tok(F.col(ref_col)).alias("_tok"))
    grams = explode_ngrams(segs, ["id", "_side"], "_tok", max_order, gram_key_is_string(tokenizer))
    per_ref = grams.groupBy("id", "_side", "n", "gram").agg(F.count(F.lit(1)).alias("c"))
    return cluster_rows(per_ref.drop("_side"), "id", "n", "gram", num_partitions=n).groupBy("id", "n", "gram").agg(F.max("c").alias("c"))


def merge_components(components: DataFrame, group_cols: Sequence[str] = (), max_order: int = 4) -> DataFrame:
    """Merge partial states (sum of every counter)."""
    keys = list(group_cols)
    return components.groupBy(*keys).agg(
        F.sum("pairs").cast("long").alias("pairs"),
        F.sum("translation_length").cast("long").alias("translation_length"),
        F.sum("reference_length").cast("long").alias("reference_length"),
        F.array(*[F.sum(F.col("matches")[k]).cast("long") for k in range(max_order)]).alias("matches"),
        F.array(*[F.sum(F.col("possible")[k]).cast("long") for k in range(max_order)]).alias("possible"),
    )


def bleu_finalize(
    components: DataFrame,
    group_cols: Sequence[str] = (),
    *,
    max_order: int = 4,
    smooth: bool = False,
    pair_weight: int = 1,
    on_empty: str = "null",
) -> DataFrame:
    """A5: precisions, geometric mean, brevity penalty from the counters.

    ``pair_weight = 2`` reproduces scoring every pair twice (as a wrapper that
    adds a batch and then computes on the same batch does).  ``on_empty``:
    ``'null'`` gives NULL scores for zero lengths, ``'raise'`` fails the job.
    """
    w = F.lit(float(pair_weight))
    m = [F.col("matches")[k] * w for k in range(max_order)]
    p = [F.col("possible")[k] * w for k in range(max_order)]
    if smooth:
        precs = [(m[k] + 1.0) / (p[k] + 1.0) for k in range(max_order)]
    else:
        precs = [F.when(p[k] > 0, m[k] / p[k]).otherwise(F.lit(0.0)) for k in range(max_order)]
    tl = F.col("translation_length") * w
    rl = F.col("reference_length") * w
    prec_arr = F.array(*precs)
    inv = F.lit(1.0 / max_order)
    log_sum = F.aggregate(prec_arr, F.lit(0.0), lambda acc, x: acc + inv * F.ln(x))
    geo = F.when(F.array_min(prec_arr) > 0, F.exp(log_sum)).otherwise(F.lit(0.0))
    ratio = F.try_divide(tl.cast("double"), rl.cast("double"))
    if on_empty == "raise":
        bad = (rl == 0) | (tl == 0)
        ratio = F.when(bad, F.raise_error(F.lit("BLEU: zero reference or translation length"))).otherwise(ratio)
    bp = F.when(ratio > 1.0, F.lit(1.0)).otherwise(F.exp(F.lit(1.0) - F.try_divide(F.lit(1.0), ratio)))
    out = components.select(
        *group_cols,
        "pairs",
        tl.cast("long").alias("translation_length"),
        rl.cast("long").alias("reference_length"),
        prec_arr.alias("precisions"),
        geo.alias("_geo"),
        ratio.alias("length_ratio"),
        bp.alias("brevity_penalty"),
    )
    return out.select(
        *group_cols,
        (F.col("_geo") * F.col("brevity_penalty")).alias("bleu_score"),
        "precisions",
        "brevity_penalty",
        "length_ratio",
        "translation_length",
        "reference_length",
        "pairs",
    )


def corpus_bleu(
    preds: DataFrame,
    refs: DataFrame | None = None,
    *,
    id_col: str = "id",
    pred_col: str = "pred",
    ref_col: str = "ref",
    group_cols: Sequence[str] = (),
    tokenizer: Tokenizer = "13a",
    max_order: int = 4,
    smooth: bool = False,
    pair_weight: int = 1,
    on_empty: str = "null",
) -> DataFrame:
    """BLEU over the whole corpus, or per group with ``group_cols``.

    Output columns: group columns, ``bleu_score``, ``precisions``,
    ``brevity_penalty``, ``length_ratio``, ``translation_length``,
    ``reference_length``, ``pairs``, ``tokenizer``.  A one-row group is
    sentence BLEU.
    """
    comp = bleu_components(
        preds,
        refs,
        id_col=id_col,
        pred_col=pred_col,
        ref_col=ref_col,
        group_cols=group_cols,
        tokenizer=tokenizer,
        max_order=max_order,
    )
    out = bleu_finalize(comp, group_cols, max_order=max_order, smooth=smooth, pair_weight=pair_weight, on_empty=on_empty)
    # T4: results carry the tokenizer signature they were computed with
    return out.withColumn("tokenizer", F.lit(tokenizer if isinstance(tokenizer, str) else "custom"))


def macro_average(scores: DataFrame, value_col: str, group_cols: Sequence[str] = (), out_col: str | None = None) -> DataFrame:
    """Unweighted mean of per-batch scores; 0 when there is no batch."""
    name = out_col or f"avg_{value_col}"
    return scores.groupBy(*group_cols).agg(F.coalesce(F.avg(value_col), F.lit(0.0)).alias(name))


def pair_predictions(
    preds: DataFrame, refs: DataFrame, id_col: str = "id"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pair predictions with references by id.

    Returns ``(pairs, preds_without_ref, refs_without_pred)``; the two anti
    joins report what a positional zip would silently drop.
    """
    pairs = preds.join(refs, id_col, "inner")
    return pairs, preds.join(refs, id_col, "left_anti"), refs.join(preds, id_col, "left_anti")
