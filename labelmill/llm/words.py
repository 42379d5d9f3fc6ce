"""Text expressions and table helpers that the operators share."""

from __future__ import annotations

import os
import string
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.operators.bits import flag_possible

# The two word patterns that the results are stated in.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed but on a shared path.

    Spark starts workers with the environment of the context; on a cluster the package is
    installed or sent with ``--py-files``, and this changes nothing.
    """
    environment = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Stored ``rows`` whose unique ``key`` is not among ``gone``.

    A bit table of fixed size tells which rows surely stay; only the others, with their texts,
    are shuffled to meet ``gone`` exactly.
    """
    told = flag_possible(rows, gone, key, "__possibly_gone")
    stay = told.where("NOT __possibly_gone").drop("__possibly_gone")
    unsure = told.where("__possibly_gone").drop("__possibly_gone")
    return stay.unionByName(unsure.join(gone.select(key), key, "left_anti"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def spaced_words(text: Column) -> Column:
    """Runs without ASCII white space; no words for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPACED_WORD), F.lit(0))


def alnum_words(text: Column) -> Column:
    """Lower-cased runs of a-z, 0-9 and everything beyond ASCII; none for a null text."""
    low = ascii_lower(F.coalesce(text, F.lit("")))
    return F.regexp_extract_all(low, F.lit(ALNUM_WORD), F.lit(0))
