"""Distributed batch prediction.

A user predictor runs inside ``mapInPandas``: it is built once per task and
fed batches of ``batch_size`` rows (Arrow batches re-cut inside the task, so no
session setting changes), so model set-up cost is paid per partition and data
moves columnar.  Nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PredictorFactory = Callable[[], Callable[[pd.DataFrame], pd.Series]]


def predict_batches(
    df: DataFrame,
    factory: PredictorFactory,
    id_col: str,
    input_cols: list[str],
    out_col: str = "prediction",
    out_type: str = "string",
    batch_size: int = 64,
    pass_cols: list[str] | None = None,
) -> DataFrame:
    """Apply the predictor built by ``factory`` to every row; output id, the
    passed-through columns and ``out_col``."""
    passed = list(pass_cols or [])
    keep = [id_col, *passed]
    schema_fields = [df.schema[c].simpleString() for c in keep]
    out_schema = ", ".join(schema_fields + [f"{out_col} {out_type}"])
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = factory()
        for arrow_batch in batches:
            for start in range(0, len(arrow_batch), batch_size):
                pdf = arrow_batch.iloc[start : start + batch_size]
                out = pdf[keep].copy()
                out[out_col] = predictor(pdf[input_cols])
                yield out

    return df.select(*dict.fromkeys([*keep, *input_cols])).mapInPandas(run, out_schema)


def argmax_predictor(logits_col: str = "logits") -> PredictorFactory:
    """Test predictor: argmax over stored logits (stands in for a model)."""

    def factory():
        def predict(pdf: pd.DataFrame) -> pd.Series:
            mat = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[logits_col]]) if len(pdf) else np.zeros((0, 1))
            return pd.Series(mat.argmax(axis=1).astype("int32"), index=pdf.index)

        return predict

    return factory
