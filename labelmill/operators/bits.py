"""Hashed bit tables: a filter of fixed size for joins whose key set has no bound.

A table of at most ``BITS / 64`` short rows is broadcast however many keys went in. It lets some
foreign rows through and never keeps a wanted one back, so an exact join must follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25


def _place(key: str) -> tuple[Column, Column]:
    at = F.pmod(F.xxhash64(key, F.lit("bit")), F.lit(BITS))
    return F.shiftright(at, 6), at.bitwiseAND(F.lit(63)).cast("int")


def flag_possible(rows: DataFrame, wanted: DataFrame, key: str, flag: str) -> DataFrame:
    """``rows`` with ``flag``: false only if ``key`` is surely not among ``wanted``."""
    word, bit = _place(key)
    table = wanted.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(
        F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits")
    )
    told = rows.withColumns({"__word": word, "__bit": bit}).join(F.broadcast(table), "__word", "left")
    found = F.col(key).isNotNull() & F.coalesce(F.expr("getbit(__bits, __bit) = 1"), F.lit(False))
    return told.withColumn(flag, found).drop("__word", "__bit", "__bits")
