"""Scoring with any Python model, loaded once per worker and called on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.functions.scoring import sigmoid_array

BATCH_SIZE = 64


def score_plugged(
    df: DataFrame, make_predict: Callable[[], Callable], inputs: list[Column],
    key: str = "id", batch_size: int = BATCH_SIZE, input_shapes: list | None = None,
) -> DataFrame:
    """``(key, logit, prob)`` from a model object.

    ``make_predict()`` runs once in each Python worker and returns the function
    that maps a batch of inputs to ``[rows, classes]`` logits. ``batch_size`` only
    sets how many rows go into one call; results must not depend on it.
    """
    udf = predict_batch_udf(
        make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
        input_tensor_shapes=input_shapes,
    )
    scored = df.select(key, udf(*inputs).alias("logit"))
    return scored.withColumn("prob", sigmoid_array(F.col("logit")))
