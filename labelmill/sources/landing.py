"""Landing: a snapshot arrives whole or not at all.

Rows are written to a staging folder beside the landing. When the write is done a manifest with
row count, files and bytes is put into it, and one rename makes the staging folder the landing:
the rename is the commit, and of two that land at once one wins. A folder without a manifest, or
with files that differ from it, is no landing: it is what a dead write left, and is landed anew.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from labelmill.sources.files import file_system, folders_in, path_exists, read_text, remove, rename_new
from labelmill.sources.readers import read_stage
from labelmill.sources.writers import write_document

MANIFEST = "_MANIFEST"
STAGING = ".staging-"


def _sizes(spark: SparkSession, folder: str) -> dict[str, int]:
    """Bytes of the data files under ``folder``, by path below it."""
    fs, target = file_system(spark, folder)
    found, files = {}, fs.listFiles(target, True)
    start = len(target.toString()) + 1
    while files.hasNext():
        status = files.next()
        name = status.getPath().toString()[start:]
        if not name.rsplit("/", 1)[-1].startswith(("_", ".")):
            found[name] = status.getLen()
    return found


def manifest(spark: SparkSession, path: str) -> dict | None:
    """``rows`` and ``files`` of a whole landing; None if there is none."""
    if not path_exists(spark, f"{path}/{MANIFEST}"):
        return None
    told = json.loads(read_text(spark, f"{path}/{MANIFEST}"))
    return told if told["files"] == _sizes(spark, path) else None


def ingest_once(source: DataFrame, path: str) -> DataFrame:
    """Land ``source`` at ``path`` unless a whole landing is there; return what is there.

    A landing cut short, by a lost driver say, is replaced; :func:`sweep` removes what its staging left.
    """
    spark = source.sparkSession
    path = path.rstrip("/")
    if manifest(spark, path) is None:
        _land(source, path)
    return read_stage(spark, path, source.schema)


def _land(source: DataFrame, path: str) -> None:
    spark = source.sparkSession
    parent, name = path.rsplit("/", 1)
    staging = f"{parent}/{STAGING}{name}-{uuid.uuid4().hex}"
    seen = Observation()
    source.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(staging)
    told = {"rows": seen.get["rows"], "files": _sizes(spark, staging)}
    write_document(spark, json.dumps(told), f"{staging}/{MANIFEST}")
    while not rename_new(spark, staging, path):
        if manifest(spark, path) is not None:  # another write was first
            remove(spark, staging)
            return
        remove(spark, path)


def sweep(spark: SparkSession, path: str, older_than_hours: float = 24) -> list[str]:
    """Remove the staging folders that dead writes of a landing left; their paths.

    A younger folder may belong to a write that still runs.
    """
    parent, name = path.rstrip("/").rsplit("/", 1)
    fs, _ = file_system(spark, parent)
    limit = (time.time() - 3600 * older_than_hours) * 1000
    left = []
    for folder in folders_in(spark, parent):
        if folder.rsplit("/", 1)[-1].startswith(f"{STAGING}{name}-"):
            status = fs.getFileStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder))
            if status.getModificationTime() <= limit:
                remove(spark, folder)
                left.append(folder)
    return left
