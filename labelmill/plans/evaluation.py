"""Score a split once, tune thresholds on val, evaluate on test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.operators.linear_model import LinearModel, pos_weight_vector, score_linear
from labelmill.operators.metrics import compare_thresholds, confusion, report, weighted_bce
from labelmill.operators.tuning import best_thresholds, pr_curve
from labelmill.session import stored
from labelmill.sources.files import path_exists
from labelmill.sources.readers import read_thresholds
from labelmill.sources.writers import write_report, write_thresholds

BASELINE_THRESHOLD = 0.35  # fixed value: the scalar that tuning is held against


def score_split(
    papers: DataFrame, model: LinearModel, split: str | None = None, key: str | None = None
) -> DataFrame:
    """``(id, y, logit, prob)`` of one split, or of every paper, with its truth.

    ``key`` names a column that is unique already, which spares writing the papers with a number.
    """
    if split is not None:
        papers = papers.where(F.col("split") == split)
    return score_linear(papers, model, key, keep=("id", "y"))


def tune_job(
    papers: DataFrame, model: LinearModel, out: str | None = None,
    baseline: float = BASELINE_THRESHOLD, key: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Thresholds per class from the val split, and scalar against tuned F1.

    The scores are written once and serve the sweep and the comparison.
    """
    scored = stored(score_split(papers, model, "val", key), "val-scores")
    tuned = stored(best_thresholds(pr_curve(scored, model.labels), model.labels), "thresholds")
    if out is not None:
        write_thresholds(tuned, out)
    policies = {"scalar": baseline, "per_class": tuned.select("label", "threshold")}
    return tuned, compare_thresholds(scored, policies, model.labels)


def resolve_thresholds(
    spark, model_dir: str, explicit: str | None = None, scalar: float = 0.5,
    labels: list[str] | None = None,
) -> float | DataFrame:
    """An explicit file, else ``<model>/thresholds``, else the scalar.

    A threshold file used for evaluation must name every class.
    """
    path = explicit or f"{model_dir.rstrip('/')}/thresholds"
    if not path_exists(spark, path):
        return scalar
    return read_thresholds(spark, path, labels, on_missing="error").select("label", "threshold")


def evaluate(
    papers: DataFrame, model: LinearModel, thresholds=None, split: str = "test",
    inclusive: bool = False, key: str | None = None,
) -> DataFrame:
    """The one-row report of a split: loss, macro and weighted F1, P, R, hit rate.

    The loss weighs classes as the model did when it was fitted.
    """
    scored = stored(score_split(papers, model, split, key), f"{split}-scores")
    loss = weighted_bce(scored, pos_weight_vector(model.bias)).scalar()
    counts = confusion(scored, thresholds, model.labels, inclusive)
    return report(counts).withColumn("loss", loss)


def eval_job(
    papers: DataFrame, model: LinearModel, model_dir: str, out: str | None = None,
    thresholds_file: str | None = None, scalar: float = 0.5, key: str | None = None,
) -> DataFrame:
    spark = papers.sparkSession
    chosen = resolve_thresholds(spark, model_dir, thresholds_file, scalar, model.labels)
    result = evaluate(papers, model, chosen, key=key)
    if out is not None:
        write_report(result, out)
    return result
