"""Data profile: distributions, coverage, per-paper sizes, split drift, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.functions.taxonomy import has_label
from labelmill.operators.lookup import ROW_BYTES, lookup
from labelmill.operators.rows import ROW, numbered
from labelmill.session import stored

MAP_BYTES = 8 << 20  # what a map that goes with every row may take


def label_distribution(df: DataFrame, column: str = "labels", by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, label, count)``: papers' labels counted; partial counts leave each task."""
    exploded = df.select(*by, F.explode(column).alias("label"))
    return exploded.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("count"))


def by_frequency() -> list[Column]:
    """Most frequent first, equal counts by name."""
    return [F.desc("count"), F.asc("label")]


def ranked(distribution: DataFrame) -> DataFrame:
    """Add ``rank`` from 1. The window has no partition: one row per distinct label only."""
    return distribution.withColumn("rank", F.row_number().over(Window.orderBy(*by_frequency())))


def top_bottom(distribution: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most and least frequent labels side by side, joined on position.

    The bottom side lists the last ``k`` in falling order, as a table's tail does.
    """
    by_rank = Window.orderBy(*by_frequency())
    placed = distribution.withColumns({
        "rank": F.row_number().over(by_rank),
        "n": F.count(F.lit(1)).over(Window.partitionBy()),
    })
    top = placed.where(F.col("rank") <= k).select(
        F.col("rank").alias("position"), F.col("label").alias("top_label"),
        F.col("count").alias("top_count"),
    )
    first_of_tail = F.greatest(F.col("n") - k, F.lit(0))
    bottom = placed.where(F.col("rank") > first_of_tail).select(
        (F.col("rank") - first_of_tail).cast("int").alias("position"),
        F.col("label").alias("bottom_label"), F.col("count").alias("bottom_count"),
    )
    return top.join(bottom, "position", "full_outer")


def coverage_curve(df: DataFrame, column: str = "labels") -> DataFrame:
    """Percent of papers holding at least one of the ``rank`` most frequent labels.

    Each paper is covered at the smallest rank among its labels, so one pass
    computes that minimum in the row, one aggregate counts papers per rank, and a
    running sum over the label-sized result gives the curve. Papers without
    labels count in the denominator. Row 0 is the empty label set. The ranks go
    with every row as one map, so the column should hold names of a list, as
    labels and codes do, and not free text.
    """
    order = ranked(label_distribution(df, column))
    pairs = F.collect_list(F.struct("label", "rank"))
    ranks = order.agg(F.map_from_entries(pairs).alias("m")).scalar()
    first = F.array_min(F.transform(column, lambda x: F.element_at("ranks", x)))
    per_rank = (
        df.select(column).withColumn("ranks", ranks)
        .groupBy(first.alias("rank")).agg(F.count(F.lit(1)).alias("papers"))
    )
    total = per_rank.agg(F.sum("papers")).scalar()

    curve = order.join(per_rank, "rank", "left").select(
        "rank", "label", F.coalesce("papers", F.lit(0)).alias("papers")
    )
    zero = df.sparkSession.range(1).select(
        F.lit(0).alias("rank"), F.lit("").alias("label"), F.lit(0).cast("bigint").alias("papers")
    )
    running = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    covered = F.sum("papers").over(running)
    return zero.unionByName(curve).select(
        "rank", "label", covered.alias("covered"),
        (covered.cast("double") / total * 100).alias("coverage"),
    )


def labels_per_paper_stats(df: DataFrame, column: str = "labels") -> DataFrame:
    n = F.size(column)
    return df.agg(
        F.avg(n).alias("avg_labels"), F.max(n).alias("max_labels"), F.min(n).alias("min_labels")
    )


def token_length_stats(df: DataFrame, mask: str = "attention_mask") -> DataFrame:
    """Mean and interpolated 95th percentile of tokens per paper.

    The exact percentile keeps one counter per distinct length; lengths are
    bounded by the encoder's ``max_length``.
    """
    n = F.aggregate(mask, F.lit(0), lambda acc, x: acc + x)
    lengths = df.select(n.alias("n"))
    return lengths.agg(
        F.avg("n").alias("avg_length"), F.percentile("n", F.lit(0.95)).alias("p95_length")
    )


def split_probs(distribution: DataFrame) -> DataFrame:
    """Share of each label within its split."""
    total = F.sum("count").over(Window.partitionBy("split"))
    return distribution.withColumn("prob", F.col("count") / total)


def align_distributions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two ``(label, count)`` frames on one label axis; a missing label counts 0."""
    a = left.select("label", F.col("count").alias("left_count"))
    b = right.select("label", F.col("count").alias("right_count"))
    return a.join(b, "label", "full_outer").na.fill(0, ["left_count", "right_count"])


def js_divergence(distribution: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence and distance (natural log) of every pair of splits.

    Works on the per-split label counts, one row per (split, label). A label
    missing from a split counts as 0 there.
    """
    probs = split_probs(distribution)
    names = probs.agg(F.array_sort(F.collect_set("split"))).scalar()
    entries = F.collect_list(F.struct("split", "prob"))
    per_label = probs.groupBy("label").agg(F.map_from_entries(entries).alias("p"))
    pairs = (
        per_label.withColumn("names", names)
        .select("p", "names", F.explode("names").alias("split_a"))
        .select("p", "split_a", F.explode(F.filter("names", lambda x: x > F.col("split_a")))
                .alias("split_b"))
    )
    p = F.coalesce(F.element_at("p", F.col("split_a")), F.lit(0.0))
    q = F.coalesce(F.element_at("p", F.col("split_b")), F.lit(0.0))
    m = (p + q) / 2

    def half(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x / m)).otherwise(0.0)

    divergence = F.greatest(F.sum(half(p) + half(q)) / 2, F.lit(0.0))
    return (
        pairs.groupBy("split_a", "split_b").agg(divergence.alias("js_divergence"))
        .withColumn("js_distance", F.sqrt("js_divergence"))
    )


def retention(df: DataFrame, column: str = "labels") -> DataFrame:
    """Papers before and after the has-a-label filter, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("original"), F.count_if(has_label(F.col(column))).alias("retained")
    )


def row_counts(df: DataFrame, by: str = "split") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"))


def unmapped_codes(df: DataFrame, codes: DataFrame, column: str = "categories") -> DataFrame:
    """Codes no label claims, with how often they occur.

    Counting first leaves one row per distinct code for the anti join.
    """
    counted = label_distribution(df, column).withColumnRenamed("label", "code")
    return counted.where(F.col("code") != "").join(codes, "code", "left_anti")


def join_codes(
    df: DataFrame, codes: DataFrame, column: str = "categories", map_bytes: int = MAP_BYTES, head_rows: int | None = None,
) -> DataFrame:
    """``(id, label)`` rows, each label of a paper once: the join form of the code lookup.

    A code table (one row per known code) that is small by its measured bytes becomes one map that
    every row meets, so repeats are removed inside the row and nothing is exchanged. A larger one
    is looked up, its most frequent codes by broadcast and the rest by a join. Papers that share an
    id stay apart.
    """
    n, size = codes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("code") + F.octet_length("label")), F.lit(0))).first()
    if n * ROW_BYTES + size > map_bytes:
        return _join_large_codes(df, codes, column, head_rows)
    pairs = codes.agg(F.map_from_entries(F.collect_list(F.struct("code", "label"))).alias("m"))
    known = df.withColumn("__codes", pairs.scalar())
    labels = F.transform(column, lambda c: F.try_element_at("__codes", c))
    own = F.array_distinct(F.array_compact(labels))
    return known.select("id", F.explode(own).alias("label"))


def _join_large_codes(df: DataFrame, codes: DataFrame, column: str, head_rows: int | None) -> DataFrame:
    rows = numbered(df.select("id", column), "coded")
    each = rows.select(ROW, F.explode(column).alias("code"))
    often = each.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    table = stored(codes.select("code", "label").join(often, "code"), "codes")
    found = lookup(each, table, "code", "n", head_rows=head_rows).select(ROW, "label").where("label IS NOT NULL").distinct()
    return rows.select(ROW, "id").join(found, ROW).select("id", "label")


def label_grid(df: DataFrame, y: str = "y") -> DataFrame:
    """Long ``(id, idx, y)`` grid of the label vectors."""
    return df.select("id", F.posexplode(y).alias("idx", "y"))
