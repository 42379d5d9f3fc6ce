"""Logits to probabilities, thresholds, predicted tags and tag maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions.taxonomy import LABELS, label_array

DEFAULT_THRESHOLD = 0.5


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def sigmoid_array(logits: Column) -> Column:
    return F.transform(logits, sigmoid)


def logit(p: Column) -> Column:
    """Log odds; finite for 0 and 1 too, which count as 1e-15 inside."""
    inside = F.greatest(F.least(p, F.lit(1.0 - 1e-15)), F.lit(1e-15))
    return F.log(inside / (F.lit(1.0) - inside))


def threshold_vector(
    thresholds: float | dict[str, float] | DataFrame | None = None,
    labels: list[str] | None = None,
    on_missing: str = "default",
    default: float = DEFAULT_THRESHOLD,
) -> Column:
    """One threshold per class as an ``array<double>`` column.

    ``thresholds`` is a scalar, a ``{label: value}`` dict, or a frame
    ``(label, threshold)``; a frame becomes a scalar subquery over at most one
    row per label, so add the vector to a frame with ``withColumn`` before using
    it inside an array function. A missing label takes ``default``, or fails
    with ``on_missing="error"``.
    """
    labels = LABELS if labels is None else labels
    if on_missing not in ("default", "error"):
        raise ValueError(f"on_missing must be 'default' or 'error', not {on_missing!r}")
    if thresholds is None:
        thresholds = default
    if isinstance(thresholds, DataFrame):
        wanted = thresholds.where(F.col("label").isin(labels))
        pairs = F.collect_list(F.struct(F.col("label"), F.col("threshold").cast("double")))
        absent: Column = F.lit(default)
        if on_missing == "error":
            absent = F.raise_error(F.lit("a label has no threshold")).cast("double")
        found = wanted.agg(F.map_from_entries(pairs).alias("m"))
        return found.select(
            F.transform(label_array(labels), lambda x: F.coalesce(F.element_at("m", x), absent))
        ).scalar()
    if isinstance(thresholds, dict):
        missing = [x for x in labels if x not in thresholds]
        if missing and on_missing == "error":
            raise KeyError(f"no threshold for {missing}")
        return F.array(*[F.lit(float(thresholds.get(x, default))) for x in labels])
    return F.array_repeat(F.lit(float(thresholds)), len(labels))


def predict(probs: Column, thresholds: Column, inclusive: bool = False) -> Column:
    """``array<boolean>``: strictly above the class threshold (or at it, if inclusive)."""
    return F.zip_with(probs, thresholds, lambda p, t: p >= t if inclusive else p > t)


def _active(probs: Column, thresholds: Column, labels, inclusive: bool) -> Column:
    zipped = F.arrays_zip(
        label_array(labels).alias("label"), probs.alias("prob"), thresholds.alias("threshold")
    )
    return F.filter(
        zipped,
        lambda z: z["prob"] >= z["threshold"] if inclusive else z["prob"] > z["threshold"],
    )


def predicted_tags(
    probs: Column, thresholds: Column, labels: list[str] | None = None, inclusive: bool = False
) -> Column:
    """Names of the active classes in index order."""
    return F.transform(_active(probs, thresholds, labels, inclusive), lambda z: z["label"])


def tag_probabilities(
    probs: Column, thresholds: Column, labels: list[str] | None = None, inclusive: bool = False
) -> Column:
    """``map<label, probability>`` of the active classes, rounded to four decimals."""
    active = _active(probs, thresholds, labels, inclusive)
    return F.map_from_entries(
        F.transform(active, lambda z: F.struct(z["label"], F.round(z["prob"], 4)))
    )
