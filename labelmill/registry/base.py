"""Named queries over the test tables and the SQL each must agree with."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def with_scratch(fn: Query) -> Query:
    """``fn`` for sessions that name no shared folder, as in trials: a local master gets one of its own."""

    @wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        setting = "spark.checkpoint.dir"
        named = spark.conf.get(setting, None) or spark.sparkContext.getConf().get(setting, None)
        if not named and spark.sparkContext.master.startswith("local"):
            spark.conf.set(setting, tempfile.mkdtemp(prefix="labelmill-"))
        return fn(spark, sf)

    return run


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL where it has one."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
