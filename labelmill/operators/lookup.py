"""Joining many occurrence rows to a per-word table without skew.

Word frequencies are heavily skewed, so a plain shuffle join on the word would
send one common word's rows to one task. The most frequent words of the table
form a head of bounded size that is broadcast; every other word is rarer than
the whole head, so the shuffle join of the tail has no hot key. The result is
the plain join's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.operators.bits import flag_possible
from labelmill.session import share_package, stored

HEAD_BYTES = 32 << 20  # what one broadcast head may take
ROW_BYTES = 48  # a row beside the bytes of its key
LONG_KEY = 256  # bytes; longer keys are never in the head
BLOCK_KEYS = 1 << 19  # keys of the rows that a task holds at a time


def most_frequent(table: DataFrame, frequency: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows of highest frequency, ties by ``key``.

    A sort with a limit would send ``n`` rows of every partition to one task.
    Here the number of rows per frequency gives the lowest frequency that can
    still be in, and only rows at or above it are sorted. ``table`` is read twice,
    so it should be a stored one.
    """
    per_frequency = table.groupBy(frequency).agg(F.count(F.lit(1)).alias("rows"))
    falling = Window.orderBy(F.desc(frequency)).rowsBetween(Window.unboundedPreceding, 0)
    upto = per_frequency.withColumn("upto", F.sum("rows").over(falling))
    cut = upto.where(F.col("upto") >= n).agg(F.max(frequency).alias("cut")).scalar()
    kept = table.where(F.col(frequency) >= F.coalesce(cut, F.col(frequency)))
    return kept.orderBy(F.desc(frequency), key).limit(n)


def _key_bytes(key: str):
    return F.octet_length(F.col(key).cast("string"))


def split_table(
    table: DataFrame, key: str, frequency: str, row_bytes: int = ROW_BYTES, head_rows: int | None = None,
    packed: tuple[int, int] | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """The head of a stored table that may be broadcast, and the tail (None if there is none).

    One pass measures the table: rows, and the bytes of their keys. ``packed`` is for a head that
    is sent as arrays beside a tail: the bytes of them all, and those of a row beside its key. Such a
    head takes as many rows of the measured length as there is room for, and is written once.
    """
    n, key_bytes = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(_key_bytes(key)), F.lit(0))).first()
    if head_rows is None:
        if n * row_bytes + key_bytes <= HEAD_BYTES:
            return table, None
        room, row = packed or (HEAD_BYTES, row_bytes + LONG_KEY)
        head_rows = room // (row + key_bytes // n + 1 if packed else row)
    elif n <= head_rows:
        return table, None
    short = table.where(_key_bytes(key) <= LONG_KEY)
    head = most_frequent(short, frequency, key, head_rows)
    if packed is not None:
        head = stored(head, "head")
    return head, table.join(F.broadcast(head.select(key)), key, "left_anti")


def lookup(
    rows: DataFrame, table: DataFrame, key: str, frequency: str, how: str = "inner",
    row_bytes: int = ROW_BYTES, head_rows: int | None = None,
) -> DataFrame:
    """``rows`` joined (inner or left) to ``table``, which has one row per ``key``.

    ``table`` should be a stored table: its measured size decides the strategy. The head takes
    ``HEAD_BYTES`` at most, or ``head_rows`` rows. Rows whose key is surely not in the tail, which
    may be many copies of one key, are not shuffled.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be 'inner' or 'left', not {how!r}")
    head, tail = split_table(table, key, frequency, row_bytes, head_rows)
    if tail is None:
        return rows.join(F.broadcast(table), key, how)
    common = rows.join(F.broadcast(head), key)
    rest = rows.join(F.broadcast(head.select(key)), key, "left_anti")
    told = flag_possible(rest, tail, key, "__possible")
    rare = told.where("__possible").drop("__possible").join(tail, key, how)
    found = common.unionByName(rare)
    if how == "inner":
        return found
    absent = told.where("NOT __possible").drop("__possible")
    return found.unionByName(absent, allowMissingColumns=True)


def stretches(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with ``most`` items together, or of one row; ``offsets`` are those of the rows' items."""
    start = 0
    while start < len(offsets) - 1:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, end
        start = end


def in_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.RecordBatch, pa.Array, np.ndarray]]:
    """Runs of rows of a task, whose last column is an array: a number of its own, the rows, their items and offsets."""
    task = TaskContext.get()
    block = (task.partitionId() if task else 0) << 33
    for batch in batches:
        rows = batch.column(batch.num_columns - 1)
        offsets = rows.offsets.to_numpy().astype(np.int64)
        for start, end in stretches(offsets, most):
            items = rows.values.slice(offsets[start], offsets[end] - offsets[start])
            yield block, batch.slice(start, end - start), items, offsets[start : end + 1] - offsets[start]
            block += 1


def others_listed(block: int, items: pa.Array, other: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """``(rest, block, words)`` of a block's rows: the ``other`` items as places in the list of the
    distinct ones, which the block's first row with an item holds."""
    places = items.filter(pa.array(other)).dictionary_encode()
    left = np.r_[0, np.cumsum(other, dtype=np.int32)][offsets].astype(np.int32)
    held = np.zeros(len(offsets), np.int32)
    held[np.searchsorted(offsets, 0, "right"):] = len(places.dictionary)
    return [
        pa.ListArray.from_arrays(pa.array(left), places.indices.fill_null(-1)),
        pa.array(np.full(len(offsets) - 1, block)),
        pa.ListArray.from_arrays(pa.array(held), places.dictionary),
    ]


def _met(head: Broadcast, own: int, names: list[str], most: int) -> Callable:
    """Task over rows of ``own`` columns and an array of keys: the values that the head has for the
    keys, null at the places of other keys, and with more ``names`` these, listed."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        keys, values = head.value
        for block, rows, items, offsets in in_blocks(batches, most):
            known = values.take(pc.index_in(items, value_set=keys))
            made = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), known)]
            if len(names) > own + 1:
                made += others_listed(block, items, known.is_null().to_numpy(zero_copy_only=False), offsets)
            yield pa.RecordBatch.from_arrays([*rows.columns[:own], *made], names)

    return met


def _filled(own: list[str]) -> Callable:
    """Rows of a block with the values that its list of keys met, each where ``known`` has none."""

    def filled(rows: pa.Table, found: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        known, rest, late = (c.combine_chunks() for c in (rows["__known"], rows["__rest"], found["__value"]))
        values, places, met = known.flatten(), rest.flatten().to_numpy(), found["__place"].to_numpy()
        # Places that met nothing, and a null key's -1, point to the end of the list: to no value.
        at = np.full(max(places.max(initial=-1), met.max(initial=-1)) + 2, -1, np.int64)
        at[met] = np.arange(len(met)) + len(values)
        take = np.arange(len(values))
        take[values.is_null().to_numpy(zero_copy_only=False)] = at[places]
        whole = pa.concat_arrays([values, late]).take(pa.array(take, mask=take < 0))
        starts = pa.array(np.r_[0, np.cumsum(pc.list_value_length(known).to_numpy())].astype(np.int32))
        made = pa.ListArray.from_arrays(starts, whole, type=known.type)
        return pa.table([*[rows[c] for c in own], made], names=[*own, "__known"])

    return filled


def gathered(
    rows: DataFrame, table: DataFrame, key: str, frequency: str, by: str | None, value: str,
    made: Callable[[Column, Column], Column], into: str, extra: tuple[str, ...] = (),
    row_bytes: int = ROW_BYTES, head_rows: int | None = None, in_row: bool = False,
) -> DataFrame:
    """``(by, *extra, into)`` of ``rows``, whose column ``key`` is an array of keys; ``into`` is sorted.

    ``made(place, value)`` is what a key adds to the list; its value is null if the key is not in
    the table, which has one row per ``key``. Rows without a key are left out. With ``in_row``,
    without ``by``, or beside a table beyond one broadcast, a row's keys meet the head in the row
    itself, with no shuffle and no sort. If there is a tail, the rows are written once, in blocks, with
    each other key as its place in the block's list of distinct ones. Only the lists meet the tail,
    however often a key occurs, and the values come back to the rows of the block. A block is of
    ``BLOCK_KEYS`` keys, or one row, and a task holds one at a time.
    """
    head, tail = split_table(table, key, frequency, row_bytes, head_rows)
    own = [*([by] if by else []), *extra]
    if tail is None and not in_row and by:
        each = rows.select(by, *extra, F.posexplode(key).alias("pos", key))
        met = each.join(F.broadcast(head.select(key, value)), key, "left")
        told = [F.max(c).alias(c) for c in extra]
        return met.groupBy(by).agg(F.sort_array(F.collect_list(made(F.col("pos"), F.col(value)))).alias(into), *told)
    spark = rows.sparkSession
    share_package(spark)
    found = head.where(F.col(key).isNotNull()).select(key, value).toArrow()
    sent = spark.sparkContext.broadcast((found[key].combine_chunks(), found[value].combine_chunks()))
    kind = lambda c: T.ArrayType(head.schema[c].dataType)
    plain = rows.select(*own, F.col(key).alias("__keys"))
    fields = [*plain.schema.fields[:-1], T.StructField("__known", kind(value))]
    if tail is not None:
        fields += [T.StructField("__rest", T.ArrayType(T.IntegerType())), T.StructField("__block", T.LongType()), T.StructField("__words", kind(key))]
    task = _met(sent, len(own), [f.name for f in fields], BLOCK_KEYS)
    met = plain.mapInArrow(task, T.StructType(fields)).where(F.size("__known") > 0)
    if tail is None:
        return met.select(*own, F.transform("__known", lambda v, i: made(i, v)).alias(into))
    part = stored(met, "gathered")
    lists = part.where(F.size("__words") > 0).select("__block", F.posexplode("__words").alias("__place", key))
    flagged = flag_possible(lists, tail, key, "__possible").where("__possible")
    late = flagged.join(tail.select(key, value), key).select(F.col("__block").alias("__of"), "__place", F.col(value).alias("__value"))
    blocks = part.drop("__words").groupBy("__block").cogroup(late.groupBy("__of"))
    whole = blocks.applyInArrow(_filled(own), part.select(*own, "__known").schema)
    return whole.select(*own, F.transform("__known", lambda v, i: made(i, v)).alias(into))
