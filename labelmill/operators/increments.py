"""Profile tables kept up as batches land: counts are added, replaced and taken back, never recounted.

A state is a folder with one small table of signed counts per landed batch and a manifest, one
file, that names the tables that count. Landing a batch counts its papers alone. Landing it again
replaces its counts, so a replay changes nothing; a retraction is a batch whose papers count
negatively, for papers that were withdrawn or have changed. The profile is the sum over the
batches, a table of labels and splits, and drift is computed from that sum.

Every change writes its table first and then replaces the manifest, in one step: a reader sees the
state before or after it, and a change that dies leaves only a table that nobody names. Replaced tables
go at once, so a frame of a profile is to be read before the next change. One writer at a time
is assumed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.operators.profiling import js_divergence, label_distribution
from labelmill.sources.files import folders_in, path_exists, read_text, remove
from labelmill.sources.writers import write_document

MANIFEST = "manifest.json"
PAPERS = ""  # in place of a label: the papers themselves
_COUNTS = "split string, label string, count bigint"


def batch_counts(papers: DataFrame, column: str = "labels", sign: int = 1) -> DataFrame:
    """``(split, label, count)`` of one batch, with a row per split for its papers."""
    labels = label_distribution(papers, column, ("split",)).where(F.col("label").isNotNull() & (F.col("label") != PAPERS))
    own = papers.groupBy("split").agg(F.count(F.lit(1)).alias("count")).select("split", F.lit(PAPERS).alias("label"), "count")
    both = labels.unionByName(own)
    return both.select("split", "label", (F.col("count") * sign).cast("bigint").alias("count"))


def batches(spark: SparkSession, state: str) -> dict[str, str]:
    """The landed batches and the folders of their counts."""
    path = f"{state}/{MANIFEST}"
    return json.loads(read_text(spark, path)) if path_exists(spark, path) else {}


def _write(counts: DataFrame, state: str) -> str:
    folder = f"counts-{uuid.uuid4().hex}"
    counts.coalesce(1).write.parquet(f"{state}/{folder}")
    return folder


def _change(spark: SparkSession, state: str, now: dict[str, str]) -> None:
    before = batches(spark, state)
    write_document(spark, json.dumps(now), f"{state}/{MANIFEST}")
    for folder in set(before.values()) - set(now.values()):
        remove(spark, f"{state}/{folder}")


def land(papers: DataFrame, state: str, batch: str, column: str = "labels", retract: bool = False) -> None:
    """Count ``papers`` into the state as ``batch``; landed again, it replaces what it was."""
    spark = papers.sparkSession
    folder = _write(batch_counts(papers, column, -1 if retract else 1), state)
    _change(spark, state, batches(spark, state) | {batch: folder})


def withdraw(spark: SparkSession, state: str, batch: str) -> None:
    """Take a whole batch out of the state."""
    _change(spark, state, {b: f for b, f in batches(spark, state).items() if b != batch})


def merge_batches(spark: SparkSession, state: str, into: str) -> None:
    """Replace all batches by one of that name with their sum, so a state of many batches stays small."""
    _change(spark, state, {into: _write(profile(spark, state, True), state)})


def sweep(spark: SparkSession, state: str) -> list[str]:
    """Remove tables that dead changes left; call it when nothing else writes."""
    named = set(batches(spark, state).values())
    left = [f for f in folders_in(spark, state) if f.rsplit("/", 1)[-1] not in named]
    for folder in left:
        remove(spark, folder)
    return left


def profile(spark: SparkSession, state: str, with_papers: bool = False) -> DataFrame:
    """``(split, label, count)`` of everything landed; what sums to nothing has no row."""
    folders = [f"{state}/{f}" for f in batches(spark, state).values()]
    if not folders:
        return spark.createDataFrame([], _COUNTS)
    rows = spark.read.schema(T.StructType.fromDDL(_COUNTS)).parquet(*folders)
    summed = rows.groupBy("split", "label").agg(F.sum("count").alias("count")).where("count <> 0")
    return summed if with_papers else summed.where(F.col("label") != PAPERS)


def papers_per_split(spark: SparkSession, state: str) -> DataFrame:
    """``(split, papers)``."""
    return profile(spark, state, True).where(F.col("label") == PAPERS).select("split", F.col("count").alias("papers"))


def drift(spark: SparkSession, state: str) -> DataFrame:
    """Divergence of every pair of splits, from the state alone."""
    return js_divergence(profile(spark, state))
