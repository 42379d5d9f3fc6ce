"""Near-duplicates by MinHash in an LSH forest, confirmed on full shingle sets.

A text's set is its distinct word shingles, kept as 64-bit hashes. Texts with one set meet first
(a plain aggregate), so what follows sees each set once. A set has ``TREES`` signatures of
``DEPTH`` minima. Each tree is the sorted order of one signature: sets that agree on a prefix lie
side by side, and the longest common prefix with a neighbour says how alike they are there. A
region, the sets with a common prefix, is split one position deeper for as long as it holds more
than ``REGION`` sets, so thin regions are cut at ``ROOT`` positions and dense ones further down.
All sets of a region that is small enough are each other's candidates. A region that is dense even
at full depth is not listed in pairs: its sets are tied to one of them.

Two sets of similarity s stay together in a tree with chance s^DEPTH at least, so the forest
misses a link at the threshold 0.85 with a chance below one in a million. A candidate pair goes
on if its signatures agree often enough (the bound leaves six standard deviations of room; pairs
of dense regions go on as they are). What hangs together then is a family. Every family is
compared on the full sets: a small one in one task; of a larger one every pair of chunks. One set
that many are linked to is held against all, and then only the sets that are not linked to it;
pairs between sets already linked cannot change the outcome. A task returns a spanning forest of
its links. Nothing is capped.

A text without words, or null, has an empty set: it is linked with nothing and is its own
component. With fewer words than a shingle the whole sequence is one. Null keys count for nothing
in a component's minimum; a component of null keys alone has a null id. Repeated rows and ids
share a component. Columns beside key and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.components import components
from labelmill.llm.words import share_package
from labelmill.operators.bits import flag_possible
from labelmill.session import stored

SHINGLE = 3
LEAST_PERCENT = 85
TREES, ROOT, DEPTH = 36, 3, 7  # positions of a signature: the first three are never told apart
REGION = 32  # sets that are each other's candidates
HOT = 20_000  # rows of a region that go on by full depth at once
HOT_REGIONS = 5_000  # at most so many are hot
CHUNK, CHUNK_HASHES = 1024, 1 << 20  # sets and hashes that are held against each other in one task, at most
LEAST_CHUNK, CHUNKS = 64, 16  # smaller families are not cut; one that is has this many chunks, or more
_ROWS = 256  # hashes multiplied at once
_BATCH = 1 << 16

_factors = np.random.default_rng(20).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)


# --- sets and signatures ---------------------------------------------------------------------


def shingle_hashes(text: bytes | None, words_in_shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a UTF-8 text.

    ``bytes.lower`` and ``bytes.split`` know ASCII letters and ASCII white space only, as wanted.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - words_in_shingle + 1)
    shingles = map(b" ".join, zip(*[words[i:] for i in range(min(words_in_shingle, len(words)))]))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, n))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Sixteen bits of each minimum, a row per tree."""
    least = np.full(TREES * DEPTH, np.uint64(0xFFFF_FFFF_FFFF_FFFF))
    for start in range(0, len(hashes), _ROWS):
        np.minimum(least, (hashes[start : start + _ROWS, None] * _factors).min(0), out=least)
    return ((least >> np.uint64(16)) & np.uint64(0xFFFF)).reshape(TREES, DEPTH)


def _joined(parts: np.ndarray) -> np.ndarray:
    """Columns of sixteen bits side by side in one number."""
    out = np.zeros(len(parts), np.uint64)
    for column in parts.T:
        out = out << np.uint64(16) | column
    return out.view(np.int64)


def prints(docs: DataFrame, key: str, text: str, words_in_shingle: int) -> DataFrame:
    """``(key, who, n, digest, first, rest)`` per row; ``digest`` names the set, null if it is empty."""

    @F.pandas_udf("n long, digest binary, first array<long>, rest array<long>")
    def column(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                hashes = shingle_hashes(t, words_in_shingle)
                if len(hashes) == 0:
                    rows.append((0, None, None, None))
                    continue
                s = signature(hashes)
                rows.append((len(hashes), _digest(hashes), _joined(s[:, :ROOT]), _joined(s[:, ROOT:])))
            yield pd.DataFrame(rows, columns=["n", "digest", "first", "rest"])

    found = docs.select(
        F.col(key).alias("key"), who(F.col(key), F.col(text)).alias("who"), column(F.col(text).cast("binary")).alias("p")
    )
    return found.select("key", "who", "p.*")


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def who(key: Column, text: Column) -> Column:
    """Names a row, to find it again when the texts are read a second time."""
    return F.xxhash64(key, text)


def agreeing(first_a: str, rest_a: str, first_b: str, rest_b: str) -> Column:
    """Positions on which two signatures agree."""

    @F.pandas_udf("int")
    def column(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        if len(a) == 0:
            return pd.Series([], dtype="int32")
        left, right = (np.hstack([np.stack(x.to_list()), np.stack(y.to_list())]) for x, y in ((a, b), (c, d)))
        same = (left.view(np.uint16) == right.view(np.uint16)).sum(1)
        return pd.Series(same - TREES * (8 - DEPTH), dtype="int32")  # less the lanes that are never set

    return column(first_a, rest_a, first_b, rest_b)


def least_agreeing(percent: int) -> int:
    positions, s = TREES * DEPTH, percent / 100
    return int(positions * s - 6 * (positions * s * (1 - s)) ** 0.5)


# --- forest ----------------------------------------------------------------------------------


def _regions(region: int) -> Callable:
    """Task over rows ``(bucket, rest, rep)`` in order: candidate pairs, and ties of dense regions."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("dense", pa.bool_())])

    def out(a: np.ndarray, b: np.ndarray, dense: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), dense))], schema=schema
        )

    def of_whole_buckets(bucket: np.ndarray, rest: np.ndarray, rep: np.ndarray) -> Iterator[pa.RecordBatch]:
        for depth in range(ROOT, DEPTH + 1):
            prefix = rest.view(np.uint64) >> np.uint64(16 * (DEPTH - depth)) if depth > ROOT else np.zeros(len(rest), np.uint64)
            starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (prefix[1:] != prefix[:-1])])
            sizes = np.diff(np.r_[starts, len(bucket)])
            number = np.repeat(np.arange(len(starts)), sizes)
            small = sizes[number] <= region
            names, reps = number[small], rep[small]
            for apart in range(1, region):
                near = np.flatnonzero(names[apart:] == names[:-apart])
                if len(near) == 0:
                    break
                yield out(reps[near], reps[near + apart], False)
            dense = ~small
            if not dense.any():
                return
            if depth == DEPTH:
                yield out(rep[dense], rep[starts[number[dense]]], True)
                return
            bucket, rest, rep = bucket[dense], rest[dense], rep[dense]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.r_[x, batch.column(i).to_numpy()] for i, x in enumerate(held)]
            if len(held[0]) < _BATCH:
                continue
            whole = int(np.searchsorted(held[0] == held[0][-1], True))
            if whole:
                yield from of_whole_buckets(*(x[:whole] for x in held))
            held = [x[whole:] for x in held]
        if len(held[0]):
            yield from of_whole_buckets(*held)

    return task


def candidates(reps: DataFrame, region: int = REGION, hot: int = HOT) -> DataFrame:
    """``(a, b, dense)`` over ``rep`` of the stored sets: neighbours in the forest, once each."""
    trees = reps.select("rep", F.posexplode(F.arrays_zip("first", "rest")).alias("tree", "at"))
    rows = trees.select(F.xxhash64("tree", "at.first").alias("bucket"), F.col("at.rest").alias("rest"), "rep")
    # Regions that would be too much for one task: few, whatever the size of the table.
    limit = max(hot, reps.count() * TREES // HOT_REGIONS)
    slot = F.pmod("bucket", F.lit(1 << 16))
    full = stored(rows.groupBy(slot.alias("slot")).count().where(F.col("count") > limit).select("slot"), "forest-slots")
    ties = None
    if not full.isEmpty():
        within = rows.withColumn("slot", slot).join(F.broadcast(full), "slot", "left_semi")
        large = stored(within.groupBy("bucket").count().where(F.col("count") > limit).select("bucket", F.lit(True).alias("hot")), "forest-hot")
        rows = rows.join(F.broadcast(large), "bucket", "left")
        deep = F.when(F.col("hot"), F.xxhash64("bucket", "rest")).otherwise(F.col("bucket"))
        rows = rows.withColumn("bucket", deep)
        least = rows.where("hot").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("least"))
        least = stored(least.where(F.col("n") > limit).select("bucket", "least"), "forest-dense")
        rows = rows.join(F.broadcast(least), "bucket", "left")
        ties = rows.where("least < rep").select(F.col("least").alias("a"), F.col("rep").alias("b"), F.lit(True).alias("dense"))
        rows = rows.where("least IS NULL")
    share_package(reps.sparkSession)
    dealt = rows.select("bucket", "rest", "rep").repartition("bucket").sortWithinPartitions("bucket", "rest")
    found = dealt.mapInArrow(_regions(region), "a long, b long, dense boolean")
    found = found.unionByName(ties) if ties is not None else found
    return found.groupBy("a", "b").agg(F.max("dense").alias("dense"))


def families(reps: DataFrame, percent: int, region: int = REGION, hot: int = HOT) -> DataFrame:
    """``(rep, family)`` of the sets that may be linked with another."""
    pairs = stored(candidates(reps, region, hot), "forest-pairs")
    sides = [
        reps.select(F.col("rep").alias(x), F.col("first").alias(f"first_{x}"), F.col("rest").alias(f"rest_{x}")) for x in "ab"
    ]
    met = pairs.where("NOT dense").join(sides[0], "a").join(sides[1], "b")
    close = met.where(agreeing("first_a", "rest_a", "first_b", "rest_b") >= least_agreeing(percent))
    edges = close.select("a", "b").unionByName(pairs.where("dense").select("a", "b"))
    return components(edges).select(F.col("node").alias("rep"), F.col("root").alias("family"))


# --- links on full sets ----------------------------------------------------------------------


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For every set the smallest index it is linked to, directly or through others."""
    root = np.arange(len(sets))
    if len(sets) < 2:
        return root
    sizes = np.array([len(s) for s in sets], np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    often = np.bincount(ids)
    # The set whose shingles are the most common is held against all first.
    middle = int(np.argmax(np.add.reduceat(often[ids], starts) / sizes))
    seen = np.zeros(len(often), bool)

    def hold(x: int) -> None:
        mine = ids[starts[x] : starts[x] + sizes[x]]
        seen[mine] = True
        both = np.add.reduceat(seen[ids], starts, dtype=np.int64)
        seen[mine] = False
        found = root[100 * both >= percent * (sizes[x] + sizes - both)]
        low = found.min()
        if (found != low).any():
            root[np.isin(root, found)] = low

    hold(middle)
    for x in np.flatnonzero(root != root[middle]):
        if root[x] != root[middle]:
            hold(int(x))
    return root


def _compared(percent: int) -> Callable:
    """Task over rows ``(tile, rep, hashes)`` in order of tile: a spanning forest of the links."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, group in groupby(rows(batches), key=lambda r: r[0]):
            sets = {rep: np.frombuffer(hashes.as_buffer(), "<u8") for _, rep, hashes in group}
            reps = sorted(sets)
            root = linked([sets[r] for r in reps], percent)
            a += [reps[r] for r in root]
            b += reps
            if len(a) >= _BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return task


def _hashes(words_in_shingle: int) -> Callable:
    @F.pandas_udf("digest binary, hashes binary")
    def column(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingle_hashes(t, words_in_shingle) for t in texts]
            yield pd.DataFrame({"digest": [_digest(s) for s in sets], "hashes": [s.tobytes() for s in sets]})

    return column


def links(
    docs: DataFrame, reps: DataFrame, key: str, text: str, words_in_shingle: int, percent: int,
    region: int = REGION, hot: int = HOT, chunk: int = CHUNK,
) -> DataFrame:
    """``(a, b)`` over ``rep``: a spanning forest of the links, confirmed on full sets."""
    members = stored(families(reps, percent, region, hot).join(reps.drop("first", "rest"), "rep"), "forest-members")
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("hashes"))
    each = F.least(F.lit(chunk), F.greatest(F.lit(LEAST_CHUNK), F.ceil(F.col("m") / CHUNKS)))
    chunks = F.greatest(F.ceil(F.col("m") / each), F.ceil(F.col("hashes") / CHUNK_HASHES)).cast("bigint")
    members = members.join(sizes.select("family", chunks.alias("chunks")), "family")
    wanted = stored(members.select("who", "rep", F.col("digest").alias("of"), "family", "chunks"), "forest-wanted")
    texts = docs.select(who(F.col(key), F.col(text)).alias("who"), F.col(text).cast("binary").alias("text"))
    # Rows that are surely not wanted go before their texts are shuffled.
    some = flag_possible(texts, wanted, "who", "some").where("some").drop("some")
    sets = some.join(wanted, "who").withColumn("s", _hashes(words_in_shingle)("text"))
    sets = sets.where(F.col("s.digest") == F.col("of"))
    own = F.pmod(F.xxhash64("rep", F.lit("chunk")), F.col("chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))
    dealt = sets.select("family", "rep", F.col("s.hashes").alias("hashes"), own.alias("own"), other.alias("other"))
    tile = F.xxhash64("family", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(tile.alias("tile"), "rep", "hashes").repartition("tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(_compared(percent), "a long, b long").where("a <> b")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words_in_shingle: int = SHINGLE, percent: int = LEAST_PERCENT,
) -> DataFrame:
    """``(key, n_shingles, component_id, kept)`` per row of ``docs``.

    The component is named by the smallest key that links can reach, and the rows with that key
    are kept. Sets are linked if they share ``percent`` in a hundred of all their shingles or more.
    """
    if not 50 < percent <= 100:
        raise ValueError("the forest is laid out for similarities above one half")
    share_package(docs.sparkSession)
    seen = stored(prints(docs, key, text, words_in_shingle).withColumn("rep", F.monotonically_increasing_id()), "forest-prints")
    # One row stands for all with its set.
    of_sets = seen.where("digest IS NOT NULL").groupBy("digest").agg(F.min("key").alias("least"), F.min("rep").alias("rep"))
    reps = stored(seen.drop("key").join(of_sets.select("rep", "least"), "rep"), "forest-sets")
    found = stored(links(docs, reps.drop("least"), key, text, words_in_shingle, percent), "forest-links")
    roots = components(found).withColumnRenamed("node", "rep")
    named = stored(
        reps.select("rep", "digest", "least").join(roots, "rep", "left").select("digest", "least", F.coalesce("root", "rep").alias("root")),
        "forest-roots",
    )
    per_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(named.join(per_root, "root").select("digest", "component_id"), "forest-named")
    own = F.when(F.col("digest").isNull(), F.col("key")).otherwise(F.col("component_id"))
    told = seen.select("key", "n", "digest").join(named, "digest", "left").withColumn("component_id", own)
    kept = F.col("key").eqNullSafe(F.col("component_id"))
    return told.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
