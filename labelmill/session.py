"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

_run_folder: ContextVar[str | None] = ContextVar("run_folder", default=None)  # of this thread's open run


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names for written intermediates."""
    named = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_SETTING, None
    )
    if not named:
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, or the open run's; nothing is written there twice."""
    return f"{_run_folder.get() or scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession, name: str = "run") -> Iterator[str]:
    """What is stored inside goes under one folder of this run, which is removed at the end.

    Results must be written elsewhere before the end: frames that read the folder are lost with
    it. A run that fails leaves its folder, for a look; remove it with the same call. Runs of other
    threads have folders of their own.
    """
    path = scratch_path(spark, name)
    outer = _run_folder.set(path)
    try:
        yield path
    finally:
        _run_folder.reset(outer)
    remove_run(spark, path)


def remove_run(spark: SparkSession, path: str) -> None:
    """Delete a run's folder in the store that holds it; only folders under the scratch root."""
    if not path.startswith(f"{scratch_root(spark)}/"):
        raise ValueError(f"{path} is not under the scratch folder")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so later jobs survive a lost executor without recomputing
    it, and gives Catalyst exact file sizes to choose join strategies from.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed but on a shared path.

    Spark starts workers with the environment of the context; on a cluster the package is
    installed or sent with ``--py-files``, and this changes nothing.
    """
    environment = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[1])
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])
