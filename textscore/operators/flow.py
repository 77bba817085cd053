"""The test run as one plan: records to a table of actual and generated texts.

Token arrays are joined (P1), shuffled and put into batches (E9), encoded to blocks
(E5), predicted batch by batch (U2), and predictions and targets are decoded (E6)
into the prediction table (S4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from textscore.operators.batches import assign_batches
from textscore.operators.encode import decode_columns, encode_pairs
from textscore.operators.infer import PredictorFactory, predict_batches
from textscore.sources.io import join_token_columns


def predict_test_set(
    records: DataFrame,
    vocab: DataFrame,
    factory: PredictorFactory,
    block_size: int,
    batch_size: int = 4,
    *,
    id_col: str = "id",
    code_col: str = "code_tokens",
    doc_col: str = "docstring_tokens",
    lower: bool = False,
    seed: int = 42,
    bos_id: int | None = None,
    eos_id: int | None = None,
    pad_id: int = 0,
    unk_id: int = 2,
) -> DataFrame:
    """``(id, position, batch_id, actual_comments, generated_comments)``, one row per record.

    The predictor gets ``input_ids`` and ``code_attention_mask`` and returns one array
    of ids for each row.  An absent token array fails the job, an empty one is an
    empty text; ids that repeat are predicted one by one.
    """
    joined = join_token_columns(records.select(id_col, code_col, doc_col), (code_col, doc_col))
    batched = assign_batches(joined, id_col, batch_size, shuffle=True, seed=seed)
    keep = ["position", "batch_id"]
    encoded = encode_pairs(
        batched, id_col, code_col, doc_col, vocab, block_size, pad_id, unk_id, lower=lower, keep_cols=keep, bos_id=bos_id, eos_id=eos_id
    )
    predicted = predict_batches(
        encoded, factory, id_col, ["input_ids", "code_attention_mask"], "generated_ids", "array<int>", batch_size, [*keep, "target_ids"]
    )
    columns = {"target_ids": "actual_comments", "generated_ids": "generated_comments"}
    return decode_columns(predicted, id_col, columns, vocab, keep)
