"""Scans. Every reader takes its schema from :mod:`labelmill.schemas`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill import schemas as S
from labelmill.functions.scoring import DEFAULT_THRESHOLD
from labelmill.functions.taxonomy import LABELS
from labelmill.sources.files import path_exists

BAD_LINE = "_corrupt_record"


def _json_lines(spark: SparkSession, path: str, schema: T.StructType, keep_bad: bool) -> DataFrame:
    if not keep_bad:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    with_bad = T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType())])
    # Lines are parsed as a column, for Spark's reader refuses to give back bad lines alone.
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE}
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", with_bad, options).alias("r")).select("r.*")


def read_papers_jsonl(spark: SparkSession, path: str, keep_bad: bool = False) -> DataFrame:
    """Snapshot scan: one JSON object per line, only the six kept fields are parsed.

    A malformed line fails the read; with ``keep_bad`` it becomes a row with its text in
    ``_corrupt_record``, which :func:`split_bad` takes apart.
    """
    return _json_lines(spark, path, S.RAW, keep_bad)


def split_bad(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the malformed lines as ``(raw_line)``."""
    bad = F.col(BAD_LINE).isNotNull()
    return rows.where(~bad).drop(BAD_LINE), rows.where(bad).select(F.col(BAD_LINE).alias("raw_line"))


def read_stage(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def select_split(df: DataFrame, split: str) -> DataFrame:
    """Rows of one split; a frame without a ``split`` column is returned whole.

    On a table written with ``partitionBy("split")`` the other splits' files are
    pruned before the scan.
    """
    return df.where(F.col("split") == split) if "split" in df.columns else df


def read_records(
    spark: SparkSession, path: str, schema: T.StructType = S.RECORDS, keep_bad: bool = False
) -> DataFrame:
    """Record scan. Blank lines are skipped; a malformed line fails the read.

    With ``keep_bad`` a malformed line becomes a row whose ``_corrupt_record``
    holds its text, for a reject output.
    """
    return _json_lines(spark, path, schema, keep_bad)


def read_label_counts(spark: SparkSession, path: str) -> DataFrame:
    """Label distribution; a malformed line fails the read."""
    return spark.read.schema(S.LABEL_COUNTS).option("header", True).option("mode", "FAILFAST").csv(path)


def read_thresholds(
    spark: SparkSession,
    path: str,
    labels: list[str] | None = None,
    default: float = DEFAULT_THRESHOLD,
    on_missing: str = "default",
) -> DataFrame:
    """``(idx, label, threshold)`` for every class from a JSON object label→value.

    No file means the default for every class. A class absent from the file takes
    the default, or raises with ``on_missing="error"``. Extra labels are ignored.
    A file that is not such an object, or a null value in it, is an error.
    """
    labels = LABELS if labels is None else labels
    dim = spark.createDataFrame(list(enumerate(labels)), "idx int, label string")
    if not path_exists(spark, path):
        return dim.withColumn("threshold", F.lit(float(default)))
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "map<string,double>", {"mode": "FAILFAST"})
    broken = F.raise_error(F.lit(f"{path} holds no map of thresholds")).cast("map<string,double>")
    # An empty part file of a written folder is not a document.
    pairs = text.where(F.trim("value") != "").select(F.explode(F.coalesce(parsed, broken)).alias("label", "t"))
    empty = F.raise_error(F.concat(F.lit("no number for "), "label")).cast("double")
    # Broadcast is bounded: a JSON object holds one value per wanted label.
    found = pairs.where(F.col("label").isin(labels)).select("label", F.coalesce("t", empty).alias("threshold"))
    joined = dim.join(F.broadcast(found), "label", "left")
    if on_missing == "error":
        absent = F.raise_error(F.concat(F.lit("no threshold for "), "label")).cast("double")
    else:
        absent = F.lit(float(default))
    return joined.select("idx", "label", F.coalesce("threshold", absent).alias("threshold"))


def read_train_log(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """One row per log entry, ``(run, step, loss, …)``, from run states.

    A single indented JSON document needs ``multiline``; one state per line is
    splittable and is the form for many runs.
    """
    return _train_states(spark, path, multiline).select("run", F.inline("log_history"))


def read_recorded_best(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """``(run, best_global_step, best_metric)`` as the run states recorded them."""
    return _train_states(spark, path, multiline).select("run", "best_global_step", "best_metric")


def _train_states(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    reader = spark.read.schema(S.TRAIN_LOG).option("multiLine", multiline)
    return reader.option("mode", "FAILFAST").json(path)
