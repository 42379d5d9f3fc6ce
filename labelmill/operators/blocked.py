"""Scores of vectors against more classes than one matrix holds, by blocked multiplication.

Vectors are laid in blocks of rows, classes in blocks of columns, and both in blocks of dimensions.
A task multiplies one block of each; a vector block is sent to every class block and a class block to
every vector block, so no task holds more than two blocks, whatever the number of classes. The
products of a row and class are summed over the blocks of dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.operators.rows import ROW, numbered, ranked_rows
from labelmill.session import share_package, stored

ROWS, CLASSES, DIMS = 4096, 1024, 1024  # of a block


def _multiplied(classes: int, dims: int):
    """``(left rows, right rows)`` of one tile: a product row per vector."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("vector_row", pa.int64()), ("products", pa.list_(pa.float64()))])
        matrix = np.zeros((dims, classes))
        at = (right["dim"].to_numpy(), right["place"].to_numpy())
        np.add.at(matrix, at, right["x"].to_numpy())
        parts = left["part"].to_pylist()
        made = [np.asarray(p, np.float64) @ matrix[: len(p)] for p in parts]  # a row at a time: no result depends on its block
        return pa.table({"vector_row": left["vector_row"], "products": pa.array(made, pa.list_(pa.float64()))}, schema=schema)

    return run


def score_blocked(
    vectors: DataFrame, weights: DataFrame, key: str, vector: str = "v",
    rows: int = ROWS, classes: int = CLASSES, dims: int = DIMS,
) -> DataFrame:
    """``(key, label, score)`` for every vector and every label of ``weights(label, dim, x)``.

    Labels are numbered first, so they may be any values and as sparse as they like; dimensions
    that a label has no weight for count as zero, and values beyond the vector as well. Null vectors
    and null elements score as zero.
    """
    share_package(vectors.sparkSession)
    spark = vectors.sparkSession
    names = stored(ranked_rows(weights.select("label").where("label IS NOT NULL").distinct(), [F.col("label")], "class_no"), "classes")
    n_classes = names.count()
    if n_classes == 0:
        return vectors.select(key).limit(0).withColumns({"label": F.lit(None).cast(weights.schema["label"].dataType), "score": F.lit(0.0)})
    class_blocks = -(-n_classes // classes)
    right = weights.join(names, "label").select(
        F.floor((F.col("class_no") - 1) / classes).cast("int").alias("cb"), F.floor(F.col("dim") / dims).cast("int").alias("db"),
        (F.col("dim") % dims).cast("int").alias("dim"), ((F.col("class_no") - 1) % classes).cast("int").alias("place"),
        F.col("x").cast("double").alias("x"),
    ).where("x IS NOT NULL")
    kept = numbered(vectors.select(key, vector), "vectors")
    n_rows = kept.count()
    row_blocks = max(1, -(-n_rows // rows))
    values = F.transform(F.coalesce(vector, F.array().cast("array<double>")), lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    spread = kept.select(F.pmod(F.xxhash64(ROW), F.lit(row_blocks)).cast("int").alias("rb"), F.col(ROW).alias("vector_row"), values.alias("v"))
    n_parts = F.greatest(F.ceil(F.size("v") / dims), F.lit(1)).cast("int")
    left = spread.select("rb", "vector_row", "v", F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("db"))
    left = left.select("rb", "vector_row", "db", F.slice("v", F.col("db") * dims + 1, F.lit(dims)).alias("part"))
    every_class = F.sequence(F.lit(0), F.lit(class_blocks - 1))
    every_row = F.sequence(F.lit(0), F.lit(row_blocks - 1))
    left = left.withColumn("cb", F.explode(every_class))
    right = right.withColumn("rb", F.explode(every_row))
    tile = ["rb", "cb", "db"]
    made = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(
        _with_block(_multiplied(classes, dims)), "cb int, vector_row long, products array<double>"
    )
    each = made.select("vector_row", "cb", F.posexplode("products").alias("place", "product"))
    summed = each.groupBy("vector_row", (F.col("cb") * classes + F.col("place") + 1).cast("bigint").alias("class_no")).agg(
        F.sum("product").alias("score")
    )
    # Places of the last block beyond the last class have no name and fall away.
    scored = summed.join(names, "class_no").select(F.col("vector_row").alias(ROW), "label", "score")
    return kept.select(ROW, key).join(scored, ROW).select(key, "label", "score")


def _with_block(run):
    def tiled(place: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        made = run(left, right)
        block = pa.array(np.full(made.num_rows, place[1].as_py(), np.int32))
        return pa.table({"cb": block, "vector_row": made["vector_row"], "products": made["products"]})

    return tiled
