"""Near-duplicates by SimHash, compared in bit-sliced blocks.

A fingerprint takes the majority of its shingles' hashes, bit by bit, over the whole text.
Texts with equal fingerprints meet first (a plain aggregate), so what follows sees distinct
64-bit numbers only.

Two fingerprints within ``radius`` bits agree on at least one of ``radius + 1`` bit ranges,
so rows that share a range form a bucket. Buckets are compared in blocks: the fingerprints lie
as 64 bit planes, one 64-lane word per 64 rows; a query row is held against every lane at once
by xoring planes and adding the outcome into carry-save counters, and words whose lanes all
exceed the radius are dropped as the planes go by. A block emits a spanning forest of the links
it found, never its pairs. A bucket beyond ``BUCKET_ROWS`` is not compared but cut by ranges of
its remaining bits; one that is still too large is dealt in chunks, every pair of chunks a
block of its own. No pair is dropped at any step.

Null and empty texts have fingerprint zero and link like any other. Repeated rows and ids
share a component. Columns beside the key and text pass through. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.components import components
from labelmill.llm.words import share_package, without
from labelmill.session import stored

SHINGLE = 3
RADIUS = 3
SEED = 42
BUCKET_ROWS = 4096  # beyond this a bucket is cut further
_BLOCK = 256  # query rows held against the planes at once
_CHUNK = 1 << 16  # shingles or rows in memory at a time
_ALL = np.uint64(0xFFFF_FFFF_FFFF_FFFF)


def simhash(text: bytes | None, words_in_shingle: int = SHINGLE) -> int:
    """Fingerprint of a UTF-8 text as a signed 64-bit number.

    ``bytes.lower`` and ``bytes.split`` know ASCII letters and ASCII white space only, as wanted.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - words_in_shingle + 1)
    shingles = map(b" ".join, zip(*[words[i:] for i in range(min(words_in_shingle, len(words)))]))
    digests = (xxhash.xxh64_intdigest(s, SEED) for s in shingles)
    votes = np.zeros(64, np.int64)
    for start in range(0, n, _CHUNK):
        h = np.fromiter(digests, "<u8", min(_CHUNK, n - start))
        votes += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    packed = np.packbits(2 * votes > n, bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprint(text: Column, words_in_shingle: int = SHINGLE) -> Column:
    """Column form of :func:`simhash`."""

    @F.pandas_udf("long")
    def column(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, words_in_shingle) for t in texts], dtype="int64")

    return column(text.cast("binary"))


# --- bit-sliced comparison -------------------------------------------------------------


def _planes(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits by row, and by plane in words of 64 rows (the last padded with zero)."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    pad = -len(prints) % 64
    rows = np.vstack([bits, np.zeros((pad, 64), np.uint8)]) if pad else bits
    packed = np.packbits(np.ascontiguousarray(rows.T), axis=1, bitorder="little")
    return bits, packed.view("<u8")


def close_pairs(prints: np.ndarray, upto: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs ``i < j`` within ``radius`` bits, in blocks, for every ``j`` below ``upto[i]``.

    ``upto`` must not fall. Pairs beyond it that happen to share a block may be given as well.
    """
    bits, planes = _planes(prints)
    digits = radius.bit_length()
    bias = (1 << digits) - 1 - radius  # a counter overflows exactly beyond the radius
    lanes = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for lo in range(0, len(prints), _BLOCK):
        hi = min(lo + _BLOCK, len(prints))
        first, last = lo // 64, -(-int(upto[hi - 1]) // 64)
        query = np.repeat(np.arange(lo, hi), last - first)
        word = np.tile(np.arange(first, last), hi - lo)
        masks = np.uint64(0) - bits[lo:hi].astype(np.uint64)
        over = np.zeros(len(query), np.uint64)
        # Lanes at or before the query itself, and past the last row, are out from the start.
        gone = np.clip(query + 1 - 64 * word, 0, 64)
        some = gone > 0
        over[some] = _ALL >> (64 - gone[some]).astype(np.uint64)
        past = np.clip(64 * (word + 1) - len(prints), 0, 64)
        ends = past > 0
        over[ends] |= _ALL << (64 - past[ends]).astype(np.uint64)
        alive = np.flatnonzero(over != _ALL)
        query, word, over = query[alive], word[alive], over[alive]
        counters = [np.full(len(query), _ALL if bias >> d & 1 else 0, np.uint64) for d in range(digits)]
        for plane in range(64):
            carry = planes[plane][word] ^ masks[query - lo, plane]
            for d in range(digits):
                counters[d], carry = counters[d] ^ carry, counters[d] & carry
            over |= carry
            if plane % 4 == 3:
                alive = np.flatnonzero(over != _ALL)
                if len(alive) == 0:
                    break
                if len(alive) < 0.75 * len(over):
                    query, word, over = query[alive], word[alive], over[alive]
                    counters = [c[alive] for c in counters]
        else:
            near = ~over
            at = np.flatnonzero(near)
            for part in np.array_split(at, max(1, len(at) // 8192)):
                hits, lane = np.nonzero(near[part][:, None] & lanes)
                yield query[part][hits], 64 * word[part][hits] + lane


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For every index the smallest index it is linked to."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            differ = x != y
            if not differ.any():
                break
            x, y = x[differ], y[differ]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _compared(radius: int, limit: int):
    """Task over rows ``(bucket, fp)`` sorted by bucket: links found, or the rows of a large bucket.

    A link is ``(null, a, b)``; a row handed on is ``(bucket, fp, null)``.
    """
    schema = pa.schema([("bucket", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def out(bucket, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema
        )

    def handed_on(bucket, fp):
        return out(bucket, fp, pa.nulls(len(fp), pa.int64()))

    def whole_runs(bucket, fp):
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        sizes = np.diff(np.r_[starts, len(bucket)])
        large = np.repeat(sizes > limit, sizes)
        if large.any():
            yield handed_on(bucket[large], fp[large])
        pairable = np.repeat((sizes > 1) & (sizes <= limit), sizes)
        if not pairable.any():
            return
        bucket, fp = bucket[pairable], fp[pairable]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        sizes = np.diff(np.r_[starts, len(bucket)])
        upto = np.repeat(starts + sizes, sizes)
        root = _roots(len(fp), close_pairs(fp.view(np.uint64), upto, radius))
        linked = fp[root] != fp  # a print may sit in several buckets of one block
        if linked.any():
            yield out(pa.nulls(int(linked.sum()), pa.int64()), fp[linked], fp[root[linked]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, fp, large = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            new_bucket, new_fp = (batch.column(i).to_numpy() for i in range(2))
            if large is not None:
                more = new_bucket == large
                if more.any():
                    yield handed_on(new_bucket[more], new_fp[more])
                    new_bucket, new_fp = new_bucket[~more], new_fp[~more]
                if len(new_fp):
                    large = None
            bucket, fp = np.r_[bucket, new_bucket], np.r_[fp, new_fp]
            if len(fp) < _CHUNK:
                continue
            open_run = int(np.searchsorted(bucket == bucket[-1], True))
            yield from whole_runs(bucket[:open_run], fp[:open_run])
            bucket, fp = bucket[open_run:], fp[open_run:]
            if len(fp) > limit:
                yield handed_on(bucket, fp)
                large, bucket, fp = bucket[-1], bucket[:0], fp[:0]
        if len(fp):
            yield from whole_runs(bucket, fp)

    return task


# --- buckets ---------------------------------------------------------------------------


def _ranges(bits: int, parts: int) -> list[tuple[int, int]]:
    cuts = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _range(number: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(number, low).bitwiseAND(F.lit((1 << width) - 1))


def _without(number: Column, low: int, width: int) -> Column:
    """The bits outside a range, closed up."""
    rest = number.bitwiseAND(F.lit((1 << low) - 1))
    if low + width < 64:
        rest = rest.bitwiseOR(F.shiftleft(F.shiftrightunsigned(number, low + width), low))
    return rest


def _by_range(prints: DataFrame, radius: int) -> DataFrame:
    """``(bucket, fp)``: a row per bit range."""
    fp = F.col("fp")
    keys = [
        F.struct(
            F.xxhash64(F.lit(i), _range(fp, low, width)).alias("bucket"), "fp",
        )
        for i, (low, width) in enumerate(_ranges(64, radius + 1))
    ]
    return prints.select(F.explode(F.array(*keys)).alias("k")).select("k.*")


def _by_two_ranges(prints: DataFrame, radius: int) -> DataFrame:
    """Finer buckets: a range, and a range of the bits it leaves open."""
    fp, keys = F.col("fp"), []
    for i, (low, width) in enumerate(_ranges(64, radius + 1)):
        rest = _without(fp, low, width)
        for j, (low2, width2) in enumerate(_ranges(64 - width, radius + 1)):
            inner = F.xxhash64(F.lit(i), _range(fp, low, width), F.lit(j), _range(rest, low2, width2))
            outer = F.xxhash64(F.lit(i), _range(fp, low, width))
            keys.append(F.struct(outer.alias("outer"), inner.alias("bucket"), "fp"))
    return prints.select(F.explode(F.array(*keys)).alias("k")).select("k.*")


def _by_chunks(handed_on: DataFrame, limit: int) -> DataFrame:
    """Every pair of chunks of a bucket as a bucket of its own."""
    half = max(1, limit // 2)
    sizes = handed_on.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # Chunks by hash are uneven; a tenth of room keeps nearly all within half a bucket.
    sizes = sizes.select("bucket", F.ceil(F.col("n") * 1.1 / half).cast("bigint").alias("chunks"))
    own = F.pmod(F.xxhash64("fp", F.lit("chunk")), F.col("chunks"))
    dealt = handed_on.join(sizes, "bucket").withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))
    dealt = dealt.select("bucket", "fp", "own", other.alias("other"))
    tile = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.select(tile.alias("bucket"), "fp")


def _without_large(buckets: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Buckets that fit a task, and the rows ``(bucket, fp)`` of those that do not (None if there are none).

    Sizes are counted where the rows are, so no large bucket is gathered to learn that it is one.
    """
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    large = stored(sizes.select("bucket"), "simhash-large")
    if large.isEmpty():
        return buckets, None
    on = stored(buckets.join(large, "bucket", "left_semi").select("bucket", "fp"), "simhash-on")
    return buckets.join(large, "bucket", "left_anti"), on


def _held(buckets: DataFrame, radius: int, limit: int) -> DataFrame:
    share_package(buckets.sparkSession)
    dealt = buckets.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(_compared(radius, limit), "bucket long, a long, b long")
    return stored(found, "simhash-links")


def links(prints: DataFrame, radius: int = RADIUS, limit: int = BUCKET_ROWS) -> DataFrame:
    """``(a, b)``: a spanning forest of the links among distinct fingerprints ``fp``.

    ``prints`` is read more than once and should be stored.
    """
    if not 1 <= radius < 32:
        raise ValueError("radius must be from 1 to 31")
    buckets, on = _without_large(_by_range(prints, radius), limit)
    found = [_held(buckets, radius, limit)]
    if on is not None:
        # Only rows of large buckets go on, and only into finer buckets of those.
        finer = _by_two_ranges(on.select("fp").distinct(), radius)
        finer = stored(finer.join(on.select(F.col("bucket").alias("outer")).distinct(), "outer", "left_semi"), "simhash-finer")
        buckets, on = _without_large(finer.select("bucket", "fp"), limit)
        found.append(_held(buckets, radius, limit))
        if on is not None:
            # Chunks are compared whatever their size; it is bounded by construction.
            found.append(_held(_by_chunks(on, limit), radius, 1 << 62).where("b IS NOT NULL"))
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges.select("a", "b")


def grouped(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp, root)`` for every distinct ``fp`` of a stored table; linked ones share their root."""
    distinct = stored(prints.select("fp").distinct(), "simhash-prints")
    linked = components(links(distinct, radius)).withColumnRenamed("node", "fp")
    found = distinct.join(linked, "fp", "left")
    return found.select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS,
    words_in_shingle: int = SHINGLE,
) -> DataFrame:
    """``(key, fp, component_id)`` per document: the smallest key that links can reach.

    Null keys count for nothing in the minimum.
    """
    share_package(docs.sparkSession)
    prints = stored(
        docs.select(F.col(key).alias("key"), fingerprint(F.col(text), words_in_shingle).alias("fp")),
        "simhash-docs",
    )
    least = prints.groupBy("fp").agg(F.min("key").alias("least"))
    roots = stored(grouped(prints, radius).join(least, "fp"), "simhash-roots")
    per_root = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(roots.join(per_root, "root").select("fp", "component_id"), "simhash-named")
    return prints.join(named, "fp").select(F.col("key").alias(key), "fp", "component_id")


def hex_of(fp: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(
    docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS,
    words_in_shingle: int = SHINGLE,
) -> DataFrame:
    """The documents without near-duplicates: of each group the one with the smallest key.

    Rows get a number when the table is stored; it decides among equal and null keys (null
    keys come last), so exactly one row of a group stays even if rows repeat.
    """
    share_package(docs.sparkSession)
    rows = stored(docs.withColumn("__simhash_row", F.monotonically_increasing_id()), "simhash-rows")
    prints = stored(
        rows.select(
            F.struct(F.col(key).isNull(), F.col(key), "__simhash_row").alias("at"),
            fingerprint(F.col(text), words_in_shingle).alias("fp"),
        ),
        "simhash-docs",
    )
    least = prints.groupBy("fp").agg(F.min("at").alias("at"))
    per_root = grouped(prints, radius).join(least, "fp").groupBy("root").agg(F.min("at").alias("at"))
    kept = per_root.select(F.col("at.__simhash_row").alias("__simhash_row"))
    every = prints.select(F.col("at.__simhash_row").alias("__simhash_row"))
    gone = stored(every.join(kept, "__simhash_row", "left_anti"), "simhash-gone")
    return without(rows, gone, "__simhash_row").drop("__simhash_row")
