"""Tag papers: clean, score, threshold, names and probabilities. Batch job on top."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from labelmill.functions.records import default_fields, resolve_id
from labelmill.functions.scoring import predicted_tags, tag_probabilities, threshold_vector
from labelmill.functions.taxonomy import multihot_to_labels
from labelmill.operators.linear_model import LinearModel, WeightParts, score_linear
from labelmill.operators.metrics import tag_ratios, tag_sums
from labelmill.operators.rows import ROW
from labelmill.operators.sampling import limit_records
from labelmill.sources.writers import write_predictions


def join_predictions(records: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Records with their predictions, matched by key rather than by position."""
    return records.join(predictions, key)


def add_tags(
    scored: DataFrame, thresholds=None, labels: list[str] | None = None, inclusive: bool = False
) -> DataFrame:
    """Add ``predicted_tags`` and ``tag_probabilities`` to rows that hold ``prob``."""
    p, t = F.col("prob"), F.col("class_threshold")
    ready = scored.withColumn("class_threshold", threshold_vector(thresholds, labels))
    tagged = ready.withColumns({
        "predicted_tags": predicted_tags(p, t, labels, inclusive),
        "tag_probabilities": tag_probabilities(p, t, labels, inclusive),
    })
    return tagged.drop("class_threshold")


def tag_papers(
    papers: DataFrame, model: LinearModel, thresholds=None, key: str | None = None,
    inclusive: bool = False, keep_input: bool = False, parts: WeightParts | None = None,
) -> DataFrame:
    """``papers`` without the abstract (unless ``keep_input``), plus predicted tags and probabilities.

    The same call serves one row or a corpus, batch or micro-batch. Every row is tagged for
    itself, whatever its id. ``key`` names a column that is unique already, if there is one.
    """
    keep = tuple(c for c in papers.columns if (keep_input or c != "abstract") and c != ROW)
    scored = score_linear(papers, model, key, keep, parts=parts)
    return add_tags(scored, thresholds, model.labels, inclusive).drop("logit", "prob")


def as_records(df: DataFrame) -> DataFrame:
    """Raw records in the tagging shape: resolved id, defaulted text, ``true_tags``.

    ``labels`` given as a multi-hot vector is decoded to names.
    """
    shaped = default_fields(df)
    true = F.lit(None).cast("array<string>")
    if "labels" in df.columns:
        numeric = dict(df.dtypes)["labels"] != "array<string>"
        true = multihot_to_labels(F.col("labels")) if numeric else F.col("labels")
        true = F.when(F.col("labels").isNotNull(), true)
    return shaped.withColumns({"id": resolve_id(df), "true_tags": true})


def inference_job(
    records: DataFrame, model: LinearModel, out: str, thresholds=None, limit: int | None = None,
    keep_input: bool = False, key: str | None = None,
) -> tuple[DataFrame, dict]:
    """Tag records, write predictions as JSONL, and report.

    With ``keep_input`` a line holds all input columns beside the predictions.

    Returns the metric frame over records that carry true tags, and the run
    summary (processed, elapsed seconds, papers per second). Both are gathered while writing.
    """
    started = time.monotonic()
    if limit is not None:
        records = limit_records(records, limit, None)
    tagged = tag_papers(as_records(records), model, thresholds, key=key, keep_input=keep_input)
    seen = Observation("run")
    sums = tag_sums(model.labels)
    observed = tagged.observe(seen, F.count(F.lit(1)).alias("processed"), *sums)
    write_predictions(observed, out, keep_input)
    elapsed = time.monotonic() - started
    found = seen.get
    n = found["processed"]
    summary = {"processed": n, "elapsed": elapsed, "papers_per_second": n / max(elapsed, 1e-9)}
    names = ["tp", "fp", "fn", "hits", "papers"]
    row = records.sparkSession.createDataFrame(
        [tuple(found[x] for x in names)], ", ".join(f"{x} bigint" for x in names)
    )
    return tag_ratios(row), summary
