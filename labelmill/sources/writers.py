"""Sinks. Row-sized outputs are written by their own tasks; only label-sized ones use one file.

A label-sized output is one file at the very path it was asked for: a task writes it beside, and a
rename puts it in place, so a reader sees the old document or the new one and nothing in between.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.sources.files import file_system, files_in, replace


OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"  # Spark's name
SPLITS_AT_ONCE = 16  # files a task holds open; with more splits it sorts its rows, as without the setting


@contextmanager
def _files_side_by_side(spark: SparkSession) -> Iterator[None]:
    """Tasks keep a file open per split, instead of sorting all their rows by split first."""
    before = spark.conf.get(OPEN_FILES)
    spark.conf.set(OPEN_FILES, SPLITS_AT_ONCE)
    try:
        yield
    finally:
        spark.conf.set(OPEN_FILES, before)


def write_stage(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_splits(
    df: DataFrame, path: str, mode: str = "overwrite", files_per_split: int | None = None
) -> None:
    """Write ``split=<name>/`` folders.

    By default each scan task writes its own part of each split, so nothing is
    shuffled. ``files_per_split`` compacts instead: rows are spread over that many
    tasks per split by a hash of ``id``, which also keeps the large train split
    off a single task. Their number is fixed, so they do not sort: a task's memory
    does not grow with its rows.
    """
    if files_per_split:
        salt = F.pmod(F.xxhash64("id"), F.lit(files_per_split))
        df = df.repartition(3 * files_per_split, "split", salt)
        with _files_side_by_side(df.sparkSession):
            df.write.mode(mode).partitionBy("split").parquet(path)
        return
    df.write.mode(mode).partitionBy("split").parquet(path)


def write_predictions(df: DataFrame, path: str, keep_input: bool = False,
                      mode: str = "overwrite") -> None:
    """One JSON object per line; a null ``true_tags`` is written as null, not dropped."""
    fields = ["id", "title", "true_tags", "predicted_tags", "tag_probabilities"]
    out = df if keep_input else df.select(*fields)
    out.write.mode(mode).option("ignoreNullFields", "false").json(path)


def _one_file(df: DataFrame, path: str, mode: str, write: Callable[[DataFrame, str], None]) -> None:
    """``df``, of one partition, as the file ``path``.

    ``write`` puts a folder beside the path; its single part is renamed, and the folder goes. A
    folder that stands at the path, as older versions left it, is replaced under ``overwrite``.
    """
    if mode not in ("overwrite", "error", "errorifexists", "ignore"):
        raise ValueError(f"a document cannot be written with mode {mode!r}")
    spark = df.sparkSession
    fs, target = file_system(spark, path)
    if mode != "overwrite" and fs.exists(target):
        if mode == "ignore":
            return
        raise FileExistsError(path)
    beside = f"{target.getParent()}/.{target.getName()}-{uuid.uuid4().hex}"
    write(df.coalesce(1), beside)
    try:
        parts = [name for name in files_in(spark, beside) if name.rsplit("/", 1)[-1].startswith("part-")]
        if len(parts) != 1:
            raise RuntimeError(f"{len(parts)} parts of a document under {beside}")
        replace(spark, parts[0], path)
    finally:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(beside), True)


def write_label_counts(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A label distribution as one CSV file with a header, most frequent label first."""
    ordered = df.select("label", "count").orderBy(F.desc("count"), "label")
    _one_file(ordered, path, mode, lambda d, to: d.write.option("header", True).csv(to))


def write_thresholds(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``(label, threshold)`` rows, one per class, as a file with a single JSON object."""
    pairs = F.array_sort(F.collect_list(F.struct("label", "threshold")))
    one = df.agg(F.to_json(F.map_from_entries(pairs)).alias("value"))
    _one_file(one, path, mode, lambda d, to: d.write.text(to))


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A metric or metadata report (one row) as a JSON file."""
    _one_file(df, path, mode, lambda d, to: d.write.option("ignoreNullFields", "false").json(to))


def write_document(spark: SparkSession, text: str, path: str) -> None:
    """A short text of the driver as the file ``path``, replacing what stands there."""
    _one_file(spark.createDataFrame([(text,)], "value string"), path, "overwrite", lambda d, to: d.write.text(to))
