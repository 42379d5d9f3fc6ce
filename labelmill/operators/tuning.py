"""Exact precision-recall curves and the best threshold of each class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.functions.scoring import DEFAULT_THRESHOLD
from labelmill.functions.taxonomy import label_name

MAX_BINS = 1024
SEARCH_STEP = 32
ROWS_PER_BIN = 2_000_000
EPSILON = 1e-8


def _bin_edges(cells: DataFrame, rows_per_bin: int) -> DataFrame:
    """``(idx, edges, steps)``: score cut points that give each class even bins.

    Held as at most ``MAX_BINS`` doubles per class. They are fetched once so that
    both users of the bins see the same cut points; any cut points give the same
    curve, they only decide how the work is divided.
    """
    grid = F.array(*[F.lit(i / MAX_BINS) for i in range(1, MAX_BINS)])
    stats = cells.groupBy("idx").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("prob", grid, F.lit(10_000)).alias("q")
    )
    rows = []
    for r in stats.collect():
        bins = min(MAX_BINS, -(-r["n"] // rows_per_bin))
        picked = [r["q"][round(i * MAX_BINS / bins) - 1] for i in range(1, bins)]
        edges = sorted(set(picked))
        steps = edges[SEARCH_STEP - 1::SEARCH_STEP]
        rows.append((r["idx"], edges, steps))
    return cells.sparkSession.createDataFrame(
        rows, "idx int, edges array<double>, steps array<double>"
    )


def _bin(prob: Column) -> Column:
    """How many edges are at or below ``prob``, by a coarse search and then a fine one."""
    coarse = F.size(F.filter("steps", lambda e: e <= prob))
    near = F.slice("edges", coarse * SEARCH_STEP + 1, SEARCH_STEP)
    return coarse * SEARCH_STEP + F.size(F.filter(near, lambda e: e <= prob))


def pr_curve(
    scored: DataFrame, labels: list[str] | None = None, rows_per_bin: int = ROWS_PER_BIN
) -> DataFrame:
    """Precision, recall and F1 of every class at each distinct score (``prob >= score``).

    Equal scores of a class collapse first. Counts above a score are then the
    totals of the higher bins (a window over bins only) plus a running sum inside
    the score's own bin, so no class ever sits in one task.
    """
    cells = scored.select(F.posexplode(F.arrays_zip("y", "prob")).alias("idx", "c")).select(
        "idx", F.col("c.prob").alias("prob"), (F.col("c.y") == 1).alias("y")
    )
    # Broadcast is bounded: one row of at most MAX_BINS numbers per class.
    edges = F.broadcast(_bin_edges(cells, rows_per_bin))
    points = (
        cells.groupBy("idx", "prob")
        .agg(F.count_if("y").alias("tp"), F.count(F.lit(1)).alias("n"))
        .join(edges, "idx")
        .select("idx", "prob", "tp", "n", _bin(F.col("prob")).alias("bin"))
    )
    totals = points.groupBy("idx", "bin").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    higher = (
        Window.partitionBy("idx").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy("idx")
    offsets = totals.select(
        "idx", "bin",
        F.coalesce(F.sum("tp").over(higher), F.lit(0)).alias("tp_above"),
        F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("n_above"),
        F.sum("tp").over(whole).alias("positives"),
    )
    inside = (
        Window.partitionBy("idx", "bin").orderBy(F.desc("prob"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    running = points.select(
        "idx", "bin", "prob",
        F.sum("tp").over(inside).alias("tp_in"), F.sum("n").over(inside).alias("n_in"),
    )
    # Broadcast is bounded: at most MAX_BINS rows per class.
    at = running.join(F.broadcast(offsets), ["idx", "bin"]).select(
        "idx", "prob", "positives",
        (F.col("tp_in") + F.col("tp_above")).alias("tp"),
        (F.col("n_in") + F.col("n_above")).alias("predicted"),
    )
    precision = F.col("tp") / F.col("predicted")
    # Without positives, recall is one everywhere and F1 zero.
    recall = F.when(F.col("positives") == 0, 1.0).otherwise(F.col("tp") / F.col("positives"))
    curve = at.withColumns({"precision": precision, "recall": recall})
    p, r = F.col("precision"), F.col("recall")
    return curve.select(
        "idx", label_name(F.col("idx"), labels).alias("label"), "prob", "tp", "predicted",
        "precision", "recall", (2 * p * r / (p + r + EPSILON)).alias("f1"),
    )


def best_thresholds(curve: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Per class the score of the highest F1, the lowest such score on ties.

    Classes with no scored paper get the default threshold and zero metrics when
    ``labels`` names them.
    """
    best = curve.groupBy("idx", "label").agg(
        F.max_by(
            F.struct("prob", "f1", "precision", "recall"), F.struct("f1", -F.col("prob"))
        ).alias("b")
    )
    found = best.select(
        "idx", "label", F.round("b.prob", 4).alias("threshold"), F.round("b.f1", 4).alias("f1"),
        F.round("b.precision", 4).alias("precision"), F.round("b.recall", 4).alias("recall"),
    )
    if labels is None:
        return found
    dim = curve.sparkSession.createDataFrame(list(enumerate(labels)), "idx int, label string")
    return dim.join(found.drop("label"), "idx", "left").na.fill(
        {"threshold": DEFAULT_THRESHOLD, "f1": 0.0, "precision": 0.0, "recall": 0.0}
    )


def tune(
    scored: DataFrame, labels: list[str] | None = None, rows_per_bin: int = ROWS_PER_BIN
) -> DataFrame:
    """Curve and pick in one call."""
    return best_thresholds(pr_curve(scored, labels, rows_per_bin), labels)
