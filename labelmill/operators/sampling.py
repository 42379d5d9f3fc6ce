"""Seeded samples, exact splits, limits.

A seeded sample of exactly ``k`` rows is "the ``k`` smallest rows by
``(hash(seed, id), id)``". Sorting the table for that would move every row, so
the ``k``-th key is located first: a histogram of the hash's upper 16 bits (at
most 65,536 rows) names the bucket it falls in, and only that bucket's ids are
ranked. What remains is a plain filter against one key, which shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.functions.hashing import row_hash
from labelmill.operators.rows import ranked_rows

BUCKET_SIZE = 1 << 16
ONE_TASK_ROWS = 10_000  # the largest limit that passes one task


def _cut_keys(
    df: DataFrame, key: str, seed: int, ranks: dict[str, Callable[[Column], Column]]
) -> tuple[Column, dict[str, Column]]:
    """The row's sort key, and per name the largest key within that many first rows."""
    h = row_hash(F.col(key), seed)
    keyed = df.select(h.alias("h"), F.col(key).cast("string").alias("k"))
    bucket = F.floor(F.col("h") / BUCKET_SIZE)

    # At most 65,536 rows from here to ``bounds``.
    histogram = keyed.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    totals = histogram.withColumns({
        "upto": F.sum("n").over(running),
        "total": F.sum("n").over(Window.partitionBy()),
    })
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), rank(F.col("total")).cast("bigint").alias("rank"))
        for name, rank in ranks.items()
    ])
    bounds = (
        totals.withColumn("want", F.explode(wanted))
        .where((F.col("want.rank") <= F.col("upto")) & (F.col("want.rank") > F.col("upto") - F.col("n")))
        .select("bucket", F.col("want.name").alias("name"),
                (F.col("want.rank") - (F.col("upto") - F.col("n"))).alias("need"))
    )

    # Broadcast is bounded: one row per name. Repeated ids collapse before the window.
    edge = (
        keyed.withColumn("bucket", bucket)
        .join(F.broadcast(bounds), "bucket")
        .groupBy("name", "need", "h", "k").agg(F.count(F.lit(1)).alias("n"))
    )
    in_order = Window.partitionBy("name").orderBy("h", "k")
    before = F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    cuts = (
        edge.withColumn("before", before)
        .where(F.col("before") < F.col("need"))
        .groupBy("name").agg(F.max(F.struct("h", "k")).alias("cut"))
    )
    row_key = F.struct(h.alias("h"), F.col(key).cast("string").alias("k"))
    return row_key, {
        name: cuts.where(F.col("name") == name).select("cut").scalar() for name in ranks
    }


def _first_rows(df: DataFrame, key: str, seed: int, rank: Callable[[Column], Column]) -> DataFrame:
    # A rank beyond the table has no cut key (null): every row is kept. A rank of zero keeps none.
    capped = {"sample": lambda n: F.least(rank(n).cast("bigint"), n)}
    row_key, cuts = _cut_keys(df, key, seed, capped)
    return df.where(row_key <= cuts["sample"])


def sample_fixed(df: DataFrame, k: int, seed: int = 42, key: str = "id") -> DataFrame:
    """Exactly ``k`` rows chosen by seeded hash order, or all rows when there are fewer.

    ``key`` is expected to be unique; rows that repeat the last chosen key are all kept.
    """
    return _first_rows(df, key, seed, lambda n: F.lit(k))


def sample_ratio(df: DataFrame, ratio: float, seed: int = 42, key: str = "id") -> DataFrame:
    """``int(N * ratio)`` rows chosen by seeded hash order."""
    if ratio >= 1.0:
        return df
    return _first_rows(df, key, seed, lambda n: F.floor(n.cast("double") * F.lit(float(ratio))))


def sample_train_val(
    df: DataFrame, ratio: float, seed: int = 42, key: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """The sampled train and val splits; val is drawn with the next seed."""
    train = sample_ratio(df.where(F.col("split") == "train"), ratio, seed, key)
    val = sample_ratio(df.where(F.col("split") == "val"), ratio, seed + 1, key)
    return train, val


def exact_split(
    df: DataFrame, seed: int = 42, holdout: float = 0.2, key: str = "id"
) -> DataFrame:
    """Add ``split`` with exact sizes: ``ceil(holdout*N)`` rows held out, half of them (up) test."""

    def held(n: Column) -> Column:
        return F.ceil(n.cast("double") * F.lit(float(holdout)))

    def train_rank(n: Column) -> Column:
        return n - held(n)

    def val_rank(n: Column) -> Column:
        return n - F.ceil(held(n) / 2)

    row_key, cuts = _cut_keys(df, key, seed, {"train": train_rank, "val": val_rank})
    return df.withColumn(
        "split",
        F.when(row_key <= cuts["train"], "train").when(row_key <= cuts["val"], "val")
        .otherwise("test"),
    )


def sample_papers(df: DataFrame, k: int, seed: int = 42, key: str = "id") -> DataFrame:
    """``k`` papers to look at; a top-k by hash, so each task sends at most ``k`` rows."""
    h = row_hash(F.col(key), seed)
    return df.orderBy(h, F.col(key)).limit(k)


def limit_records(df: DataFrame, n: int, key: str | None = "id") -> DataFrame:
    """The first ``n`` records by ``key`` (nulls first); any ``n`` records when ``key`` is None.

    A limit passes its rows through one task. Beyond ``ONE_TASK_ROWS`` the last key that is still
    in is found first, over the keys alone, and the rows are filtered where they are. Without a key
    the rows' own hash orders them, which a histogram cuts. Of rows that repeat the last key as
    many are taken as are missing.
    """
    if n <= ONE_TASK_ROWS:
        return (df.orderBy(key) if key else df).limit(n)
    if key is None:
        own = F.xxhash64(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
        return _limit_by_hash(df.withColumn("__own", own), n).drop("__own")
    total, nulls = df.agg(F.count(F.lit(1)), F.count_if(F.col(key).isNull())).first()
    if total <= n:
        return df
    if n <= nulls:
        return _some_of(df.where(F.col(key).isNull()), n)
    keys = df.where(F.col(key).isNotNull()).select(key)
    placed = ranked_rows(keys, [F.col(key)], "__place")
    last = placed.where(F.col("__place") == n - nulls).first()[key]
    below = keys.where(F.col(key) < F.lit(last)).count()
    whole = df.where(F.col(key).isNull() | (F.col(key) < F.lit(last)))
    return whole.unionByName(_some_of(df.where(F.col(key) == F.lit(last)), n - nulls - below))


def _some_of(df: DataFrame, n: int) -> DataFrame:
    """Any ``n`` of equal rows, of which there seldom are many."""
    return df.limit(n) if n <= ONE_TASK_ROWS else limit_records(df, n, None)


def _limit_by_hash(df: DataFrame, n: int) -> DataFrame:
    total = df.count()
    if total <= n:
        return df
    row_key, cuts = _cut_keys(df, "__own", 0, {"last": lambda _: F.lit(n)})
    keyed = df.withColumn("__key", row_key)
    below = keyed.where(F.col("__key") < cuts["last"])
    # Rows of one hash are copies, or nearly never others: one task takes what is missing.
    ties = keyed.where(F.col("__key") == cuts["last"]).limit(n - below.count())
    return below.unionByName(ties).drop("__key")


def peek_row(df: DataFrame, key: str = "id") -> DataFrame:
    return limit_records(df, 1, key)


def union_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """Named frames of one schema as one frame with a ``split`` column."""
    parts = [d.withColumn("split", F.lit(name)) for name, d in splits.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
