"""From raw documents to packed training sequences.

Every stage takes the stored rows of the one before and works on all of them; its decisions take
effect. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.llm import decontaminate, packing, pseudonyms, quality_rules, simhash
from labelmill.llm.words import table
from labelmill.session import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current rule policy rejects go."""
    return quality_rules.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses are replaced; ``n_chars`` follows a changed text."""
    if "n_chars" not in docs.columns:
        return pseudonyms.pseudonymised(docs, pseudonyms.DEMO_KEY, count=None)
    before = docs.withColumn("__pipeline_before", F.length("text"))
    after = pseudonyms.pseudonymised(before, pseudonyms.DEMO_KEY, count=None)
    grown = (F.length("text") - F.col("__pipeline_before")).cast("bigint")
    n_chars = F.col("n_chars") + F.coalesce(grown, F.lit(0))
    return after.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).drop("__pipeline_before")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in the training sequences."""
    return packing.packed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("simhash", one_of_each),
    ("decontamination", without_benchmark),
    ("pseudonyms", pseudonymise),
    ("packing", pack),
]

# Fingerprints, keyed hashes and a tokenizer are beyond SQL; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = stored(stage(spark, rows, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, rows, sf_dir)
