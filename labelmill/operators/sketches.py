"""Quantiles from stored sketches: merged when asked for, instead of reading the values again.

A sketch of one group, say a split and a day, is a few kilobytes however many values went in. Groups
are sketched once, as they arrive; a quantile over any union of groups merges their sketches. The
rank of what comes back is off by at most ``rank_error(k)`` of the values, with 99 % confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 1000  # how finely a sketch tells ranks apart


def rank_error(k: int = K) -> float:
    """The published bound of the sketch on the share of values by which a quantile's rank may be off."""
    return 2.296 / k**0.9021


def sketched(df: DataFrame, value: str, by: tuple[str, ...], k: int = K) -> DataFrame:
    """``(*by, n, total, least, most, sketch)``: one row per group, to be stored."""
    v = F.col(value).cast("bigint")
    return df.where(v.isNotNull()).groupBy(*by).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"),
        F.kll_sketch_agg_bigint(v, F.lit(k)).alias("sketch"),
    )


def merged(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sketches of coarser groups, or of everything; what was merged can be merged again."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"),
        F.max("most").alias("most"), F.kll_merge_agg_bigint("sketch").alias("sketch"),
    ).where("n > 0")


def quantile(p: float, sketch: str = "sketch") -> Column:
    return F.kll_sketch_get_quantile_bigint(sketch, F.lit(float(p)))


def rank(value: Column, sketch: str = "sketch") -> Column:
    """Share of the values at or below ``value``, by the sketch."""
    return F.kll_sketch_get_rank_bigint(sketch, value.cast("bigint"))


def length_summary(sketches: DataFrame, by: tuple[str, ...] = (), p: float = 0.95) -> DataFrame:
    """``(*by, n, mean, least, most, quantile)`` of merged groups; all but the quantile are exact."""
    return merged(sketches, by).select(
        *by, "n", (F.col("total") / F.col("n")).alias("mean"), "least", "most", quantile(p).alias("quantile")
    )


def rank_bounds(df: DataFrame, value: str, found: DataFrame, by: tuple[str, ...], quantile_column: str = "quantile") -> DataFrame:
    """``(*by, below, upto)``: exact shares of the values below, and at or below, what a sketch gave.

    One pass over the values; ``found`` has a row per group. The asked-for share lies between the
    two, give or take the sketch's rank error.
    """
    if by:
        near = df.join(F.broadcast(found.select(*by, quantile_column)), list(by))
    else:
        near = df.withColumn(quantile_column, found.select(quantile_column).scalar())
    n = F.count(value)
    return near.groupBy(*by).agg(
        (F.count_if(F.col(value) < F.col(quantile_column)) / n).alias("below"),
        (F.count_if(F.col(value) <= F.col(quantile_column)) / n).alias("upto"),
    )
