"""Uniform sharding with exact shard sizes through a drawn communication matrix.

How many rows of input partition ``p`` go to shard ``s`` is drawn before a row moves: given
the partition sizes and the shard sizes, a uniform shuffle makes that matrix multivariate
hypergeometric. It is drawn by halving the list of partitions: the left half's share of each
shard is one hypergeometric draw after another, the right half gets the rest, and both halves
go on alone, so a level's draws are independent rows. Each draw inverts the distribution
function, with the weights built outwards from the mode as ratios; what lies beyond 12 standard
deviations (a chance below 1e-30) is left out.

Then the rows of a partition are permuted among themselves and dealt to the shards by the
counts of their partition's matrix row, exchanged, and permuted again inside their shard. The
second permutation is cut into ranges of a random key, so no task holds a whole shard.

Keys are bijective hashes of a row number given when the table is stored, so a task that runs
again repeats its rows. Rows need no id: nulls, empty and long texts, repeated rows and equal
ids are rows like any other, and an empty table gives an empty result. Columns of the input
pass through; one named ``shard`` or ``slot`` is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.session import stored

SEED = 7
SLOTS_PER_TASK = 100_000  # rows of a shard that are ordered together
_ROW, _PART = "__shard_row", "__shard_part"


def _uniform(*parts: str) -> str:
    """A number in (0, 1) from a hash of SQL expressions."""
    return f"((shiftrightunsigned(xxhash64({', '.join(parts)}), 11) + 0.5D) * pow(2D, -53))"


def _draw(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL for one hypergeometric draw: how many of ``drawn`` out of ``total`` are marked.

    ``g`` holds the parameters as doubles, ``r`` the range of values around the mode.
    """
    def up(k: str) -> str:
        return f"((g.marked - {k}) * (g.drawn - {k})) / (({k} + 1D) * (g.rest - g.drawn + {k} + 1D))"

    def down(k: str) -> str:
        return f"({k} * (g.rest - g.drawn + {k})) / ((g.marked - {k} + 1D) * (g.drawn - {k} + 1D))"

    rising = "sequence(r.mode, r.hi)"
    falling = "if(r.lo < r.mode, sequence(r.mode - 1, least(r.lo, r.mode - 1)), cast(array() AS array<bigint>))"

    def weight(over: str, start: str, ratio: str) -> str:
        return f"""aggregate({over}, struct({start} AS w, 0D AS s),
            (a, k) -> struct(a.w * {ratio} AS w, a.s + a.w AS s), a -> a.s)"""

    def walk(over: str, start: str, left: str, ratio: str) -> str:
        return f"""aggregate({over}, struct({start} AS w, {left} AS t, -1L AS at),
            (a, k) -> struct(a.w * {ratio} AS w, a.t - a.w AS t,
              if(a.at < 0 AND a.t <= a.w, k, a.at) AS at))"""

    return f"""
    if({drawn} = 0 OR {marked} = 0, 0L, if({drawn} = {total}, {marked},
      transform(transform(transform(
        array(struct(cast({total} AS double) AS rows, cast({marked} AS double) AS marked,
                     cast({total} - {marked} AS double) AS rest, cast({drawn} AS double) AS drawn)),
        g -> struct(g, greatest(0D, g.drawn - g.rest) AS lo, least(g.drawn, g.marked) AS hi,
          floor((g.drawn + 1) * (g.marked + 1) / (g.rows + 2)) AS mode,
          12 + ceil(12 * sqrt(g.drawn * (g.marked / g.rows) * (g.rest / g.rows)
            * (g.rows - g.drawn) / greatest(g.rows - 1, 1D))) AS reach)),
        x -> struct(x.g AS g, cast(greatest(x.lo, least(x.hi, x.mode)) AS bigint) AS mode,
          cast(greatest(x.lo, x.mode - x.reach) AS bigint) AS lo,
          cast(least(x.hi, x.mode + x.reach) AS bigint) AS hi)),
        r -> transform(array(r.g), g ->
          transform(array({u} * ({weight(rising, "1D", up("k"))} + {weight(falling, down("r.mode"), down("k"))})), t ->
            transform(array({walk(rising, "1D", "t", up("k"))}), b ->
              if(b.at >= 0, b.at,
                transform(array({walk(falling, down("r.mode"), "b.t", down("k"))}), c ->
                  if(c.at >= 0, c.at, r.mode))[0]))[0])[0])[0])[0]))
    """


def _left_share(seed: int) -> str:
    """SQL: the left half's rows of every shard, drawn shard by shard from ``sizes``."""
    drawn = _draw("s.total", "sizes[j]", "s.need", _uniform(f"{seed}L", "node", "j"))
    return f"""
    aggregate(sequence(0, size(sizes) - 1),
      struct(cast(array() AS array<bigint>) AS share, left_rows AS need,
             aggregate(sizes, 0L, (a, x) -> a + x) AS total),
      (s, j) -> transform(array({drawn}), x ->
        struct(concat(s.share, array(x)) AS share, s.need - x AS need, s.total - sizes[j] AS total))[0],
      s -> s.share)
    """


def matrix(counts: DataFrame, sizes: list[int], seed: int = SEED) -> DataFrame:
    """``(part, sizes)`` from ``counts(part, n)``: each partition's drawn rows per shard.

    The counts meet in one row at the root: one pair of numbers per input partition, which is
    what any scheduler holds. Nodes are spread over tasks once there are many.
    """
    parts = counts.count()
    nodes = counts.agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts")).select(
        F.lit(1).cast("bigint").alias("node"), "parts",
        F.lit([int(s) for s in sizes]).cast("array<bigint>").alias("sizes"),
    ).where(F.size("parts") > 0)
    for level in range(max(0, math.ceil(math.log2(max(1, parts))))):
        if level and level % 8 == 0:
            nodes = stored(nodes, "shard-nodes").repartition("node")
        half = F.expr("slice(parts, 1, size(parts) div 2)")
        split = nodes.withColumn("left_parts", half).withColumn(
            "left_rows", F.expr("aggregate(left_parts, 0L, (a, x) -> a + x.n)")
        )
        split = split.withColumn("left_sizes", F.expr(_left_share(seed)))
        children = F.expr("""
            explode(if(size(parts) = 1, array(struct(node, parts, sizes)), array(
              struct(2 * node AS node, left_parts AS parts, left_sizes AS sizes),
              struct(2 * node + 1 AS node,
                     slice(parts, size(left_parts) + 1, size(parts) - size(left_parts)) AS parts,
                     zip_with(sizes, left_sizes, (a, b) -> a - b) AS sizes))))
        """)
        nodes = split.select(children.alias("c")).select("c.*")
    return nodes.select(F.col("parts")[0]["part"].alias("part"), "sizes")


def even_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def _key(seed: int, salt: int) -> Column:
    """A bijection of the row number, so keys never tie."""
    return F.xxhash64(F.col(_ROW).bitwiseXOR(F.xxhash64(F.lit(seed), F.lit(salt))))


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards - 1``) and ``slot``, gapless from 0 in each shard.

    Shard sizes differ by one at most and every arrangement of rows is equally likely.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    # A partition's rows are permuted where they are, by a sort on the key; the place is stored with the row.
    numbered = df.withColumns({_PART: F.spark_partition_id(), _ROW: F.monotonically_increasing_id()})
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    rows = stored(numbered.sortWithinPartitions(_key(seed, 1)).withColumn("__shard_at", place), "shard-rows")
    counts = stored(rows.groupBy(F.col(_PART).alias("part")).agg(F.count(F.lit(1)).alias("n")), "shard-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    drawn = stored(matrix(counts, even_sizes(total, shards), seed), "shard-matrix")

    # The permuted rows of a partition are dealt out by its counts.
    dealt = rows.join(drawn.withColumnRenamed("part", _PART), _PART)
    shard = F.expr("""
        aggregate(sizes, struct(0L AS upto, 0 AS shard), (a, n) -> struct(
          a.upto + n AS upto, a.shard + if(__shard_at > a.upto + n, 1, 0) AS shard), a -> a.shard)
    """)
    moved = stored(dealt.withColumn("shard", shard).drop("sizes", "__shard_at", _PART), "shard-moved")

    # Permute again: ranges of a second key, counted first, give each range its offset.
    bits = max(0, math.ceil(math.log2(max(1, total / shards / SLOTS_PER_TASK))))
    span = F.shiftrightunsigned(_key(seed, 2), 64 - bits) if bits else F.lit(0).cast("bigint")
    moved = moved.withColumn("__shard_span", span)
    before = Window.partitionBy("shard").orderBy("__shard_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = moved.groupBy("shard", "__shard_span").agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.select("shard", "__shard_span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__shard_from"))
    inside = Window.partitionBy("shard", "__shard_span").orderBy(_key(seed, 2))
    placed = moved.withColumn("slot", F.row_number().over(inside).cast("bigint") - 1)
    placed = placed.join(offsets, ["shard", "__shard_span"])
    placed = placed.withColumn("slot", F.col("slot") + F.col("__shard_from"))
    names = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    return placed.select(*[F.col(f"`{c}`") for c in names], "shard", "slot")
