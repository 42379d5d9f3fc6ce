"""Rows that every operator must stand: nulls, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SYLLABLES = "an ba ce do el fi ga ho in ju ka lo mi no or pe qu ra si ta".split()


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    made = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(words)]
    return " ".join(made) + "."


def texts() -> list[str | None]:
    base = prose(1, 120)
    return [
        base, base, base + " extra", prose(2, 60), prose(3, 9), "", None, "   \n\t ", "ÄÖ é 漢字 \U0001f600 a",
        "one two three " * 40, "same line\nsame line\nother\n\n\n", "#### $$$ | <b>", prose(4, 30_000),
        "x" * 100_000, "A a A a", "!!! wow!!! " * 30, base.upper(),
    ]


def documents(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """``(doc_id, text)`` and columns whose names operators use inside."""
    if rows is None:
        found = texts()
        rows = list(enumerate(found)) + [(0, found[0]), (None, found[3]), (None, None)]
    schema = (
        "doc_id long, text string, n_words string, score string, row string, key string, fp string, "
        "shard string, slot string, pos string, term string, length string, bin string, N_CHARS long"
    )
    return spark.createDataFrame([(i, t, *["x"] * 11, 7) for i, t in rows], schema).repartition(3)


def none(spark: SparkSession) -> DataFrame:
    return documents(spark, [])
