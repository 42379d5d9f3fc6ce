"""Category codes, the label dimension, and the label-vector expressions.

Everything here is a column expression over arrays, so mapping codes to labels
or building a multi-hot vector never shuffles a row.
"""

from __future__ import annotations

import csv
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _read_codes() -> dict[str, str]:
    text = resources.files("labelmill.functions").joinpath("label_codes.csv").read_text("utf-8")
    rows = csv.DictReader(line for line in text.splitlines() if not line.startswith("#"))
    return {row["code"]: row["label"] for row in rows}


CODE_TO_LABEL = _read_codes()
LABELS = sorted(set(CODE_TO_LABEL.values()))
RECORD, UNIT = "\x1e", "\x1f"  # separators no code or label contains


def code_dim(spark: SparkSession) -> DataFrame:
    """``(code, label)``, one row per known code."""
    return spark.createDataFrame(sorted(CODE_TO_LABEL.items()), "code string, label string")


def label_dim(spark: SparkSession, labels: list[str] | None = None) -> DataFrame:
    """``(idx, label)``: position of each label in every label vector."""
    rows = list(enumerate(LABELS if labels is None else labels))
    return spark.createDataFrame(rows, "idx int, label string")


def name_array(names: list[str]) -> Column:
    """A constant array of names, folded from one string so that plans stay small."""
    return F.split(F.lit(UNIT.join(names)), UNIT)


def label_array(labels: list[str] | None = None) -> Column:
    return name_array(LABELS if labels is None else labels)


def label_name(idx: Column, labels: list[str] | None = None) -> Column:
    """Name at ``idx``, or ``LABEL_<idx>`` where the model knows more classes than names."""
    known = F.try_element_at(label_array(labels), idx.cast("int") + 1)
    return F.coalesce(known, F.concat(F.lit("LABEL_"), idx.cast("string")))


def _code_map(mapping: dict[str, str]) -> Column:
    text = RECORD.join(UNIT.join(pair) for pair in sorted(mapping.items()))
    return F.str_to_map(F.lit(text), F.lit(RECORD), F.lit(UNIT))


def codes_to_labels(codes: Column, mapping: dict[str, str] | None = None) -> Column:
    """Sorted distinct labels of an array of codes; unknown codes are dropped."""
    lookup = _code_map(CODE_TO_LABEL if mapping is None else mapping)
    named = F.transform(codes, lambda c: F.element_at(lookup, c))
    return F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull())))


def multihot(names: Column, labels: list[str] | None = None) -> Column:
    """0.0/1.0 vector over the ordered class list; names outside it are ignored.

    One expression per class rather than a lambda: it compiles, and ``names`` is
    not evaluated again for every class when it is itself computed.
    """
    hot = [F.array_contains(names, x) for x in (LABELS if labels is None else labels)]
    return F.array(*[F.when(h, 1.0).otherwise(0.0) for h in hot])


def multihot_to_labels(y: Column, labels: list[str] | None = None) -> Column:
    """Names whose vector entry is exactly one, in index order."""
    pairs = F.arrays_zip(label_array(labels).alias("label"), y.alias("y"))
    return F.transform(F.filter(pairs, lambda p: p["y"] == 1), lambda p: p["label"])


def has_label(names: Column) -> Column:
    return F.coalesce(F.size(names), F.lit(0)) > 0


def binarize_pivot(df: DataFrame, key: str, names: str, labels: list[str]) -> DataFrame:
    """One 0/1 integer column per class, the matrix form of :func:`multihot`.

    The class list is known, so each column is an expression of its own row and
    no pivot shuffle is needed.
    """
    return df.select(
        key, *[F.array_contains(names, label).cast("int").alias(label) for label in labels]
    )


