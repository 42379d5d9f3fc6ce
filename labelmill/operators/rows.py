"""Row numbers: a unique key for rows whose own ids may repeat, and ranks over many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.session import stored

ROW = "__row"


def numbered(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` written once with a unique ``__row``; reading it again gives the same numbers."""
    return stored(df.withColumn(ROW, F.monotonically_increasing_id()), name)


def ranked_rows(df: DataFrame, order: list[Column], into: str) -> DataFrame:
    """``df`` with its place (from 1) in ``order``, without one task holding all rows.

    Rows are dealt to ranges of the order and written; the ranges' sizes give each range its
    first place. Ties beyond ``order`` are broken arbitrarily.
    """
    part = f"{into}__part"
    ranges = stored(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    first = ranges.groupBy(part).agg(F.count(F.lit(1)).alias("n")).select(
        part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"{into}__first")
    )
    inside = Window.partitionBy(part).orderBy(*order)
    placed = ranges.withColumn(into, F.row_number().over(inside)).join(first, part)
    return placed.withColumn(into, F.col(into) + F.col(f"{into}__first")).drop(part, f"{into}__first")
