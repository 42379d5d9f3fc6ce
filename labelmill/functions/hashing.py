"""Seeded, engine-independent row hashing used for splits and samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = 10_000


def row_hash(key: Column, seed: int) -> Column:
    """First 32 bits of ``md5("seed:key")`` as a non-negative bigint."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_split(key: Column, seed: int = 42, train: float = 0.8, val: float = 0.1) -> Column:
    """Stable train/val/test name per key; membership survives any repartitioning."""
    band = row_hash(key, seed) % BANDS
    return (
        F.when(band < round(train * BANDS), "train")
        .when(band < round((train + val) * BANDS), "val")
        .otherwise("test")
    )
