"""Documents packed into fixed-length token sequences by best fit and local search.

A document's ids end with a separator. One longer than a sequence is cut, the short piece
first; full pieces are sequences of their own. The others are dealt at random to groups of
bounded size. A group starts from best-fit decreasing, then exchanges pieces between underfull
bins: it takes the emptiest and hands on what it holds by moves, one-for-one, two-for-one and
one-for-two swaps towards fuller bins, so that the sum of squared fills rises with every step,
until the bin is empty or no step is left. It ends when what is free elsewhere cannot
hold any further bin. The underfull bins of all groups are dealt anew, to fewer groups if they
have become fewer, and searched again, until one group held them all, or their number is
the least that their pieces allow (by tokens, and by pieces of more than half a sequence), or two
deals in a row have neither freed nor filled a single bin. ``STALLED`` is that number of deals.

Ids come from a public byte-level BPE vocabulary; its rank form is used because it is several
times faster, and gives the ids of the ``tokenizers`` file (tested). Texts with a very
long run without spaces go through ``tokenizers``, which stays fast on them.

Null and empty texts are one piece that holds the separator. Keys play no part: repeated rows
and null or equal keys are packed each for itself. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelmill.llm.words import share_package
from labelmill.session import stored

LENGTH = 1024
END = 2
GROUP_PIECES = 20_000
STALLED = 2
_LONG_RUN = re.compile(r"\S{5000}")


@lru_cache(maxsize=2)
def _fast(path: str):
    """The vocabulary beside a ``tokenizers`` file, as ranks."""
    import public_tokenizers
    import tiktoken

    with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    special = {"<|endoftext|>": len(ranks)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def _exact(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def token_ids(text: str | None, path: str) -> list[int]:
    """Ids of a whole text, without special tokens added."""
    if not text:
        return []
    if _LONG_RUN.search(text):
        return _exact(path).encode(text, add_special_tokens=False).ids
    return _fast(path).encode(text, allowed_special="all")


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """``(start, size)`` of the pieces of ``n`` tokens; only the first may be short."""
    first = (n - 1) % length + 1
    return [(0, first)] + [(at, length) for at in range(first, n, length)]


def pieces(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
    length: int = LENGTH, end: int = END, with_ids: bool = False,
) -> DataFrame:
    """``(piece_row, key, piece, start, length, ids_crc32[, ids])``, stored."""
    share_package(docs.sparkSession)
    path = path or default_vocabulary()
    key_type = docs.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                rows = []
                part = batch.iloc[lo : lo + 1000]
                for k, t in zip(part["key"], part["text"]):
                    ids = np.array([*token_ids(t, path), end], "<u4")
                    for i, (start, size) in enumerate(cut(len(ids), length)):
                        own = ids[start : start + size]
                        row = (k, i, start, size, zlib.crc32(own.tobytes()))
                        rows.append((*row, own.astype(np.int32)) if with_ids else row)
                names = ["key", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
                out = pd.DataFrame(rows, columns=names)
                out["key"] = out["key"].astype(part["key"].dtype)
                yield out

    schema = f"key {key_type}, piece int, start long, length long, ids_crc32 long"
    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    made = read.mapInPandas(encode, schema + ", ids array<int>" * with_ids)
    return stored(made.withColumn("piece_row", F.monotonically_increasing_id()), "pieces")


# --- one group -------------------------------------------------------------------------


def best_fit(sizes: np.ndarray, length: int) -> np.ndarray:
    """Bin numbers by best-fit decreasing."""
    bins = np.zeros(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(length + 1)]  # bins by free space
    spaces: list[int] = []  # the free spaces that some bin has, rising
    count = 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        at = bisect_left(spaces, size)
        if at == len(spaces):
            b, left, count = count, length - size, count + 1
        else:
            free = spaces[at]
            b, left = room[free].pop(), free - size
            if not room[free]:
                spaces.pop(at)
        bins[i] = b
        if left:
            if not room[left]:
                spaces.insert(bisect_left(spaces, left), left)
            room[left].append(b)
    return bins


def _best(gain: np.ndarray, room: np.ndarray) -> tuple | None:
    """Index of the best step: one that fills a bin exactly, else the largest gain."""
    ok = (gain > 0) & (gain <= room)
    if not ok.any():
        return None
    score = np.where(ok, gain + (gain == room) * (1 << 20), 0)
    return np.unravel_index(int(score.argmax()), score.shape)


def _pairs_within(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of items that share a bin; ``bins`` is sorted."""
    left, right, step = [], [], 1
    while step < len(bins):
        same = np.flatnonzero(bins[step:] == bins[:-step])
        if len(same) == 0:
            break
        left.append(same)
        right.append(same + step)
        step += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def local_search(sizes: np.ndarray, bins: np.ndarray, length: int) -> np.ndarray:
    """Better bin numbers: squared fill rises with every exchange."""
    bins = bins.copy()
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    stuck: set[tuple] = set()
    while True:
        open_bins = np.flatnonzero((fill > 0) & (fill < length))
        held = np.flatnonzero((fill[bins] > 0) & (fill[bins] < length))
        held = held[np.argsort(bins[held], kind="stable")]
        donor = None
        free = int((length - fill[open_bins]).sum())
        edges = np.searchsorted(bins[held], open_bins, "left"), np.searchsorted(bins[held], open_bins, "right")
        for at in np.argsort(fill[open_bins], kind="stable"):
            x = open_bins[at]
            if free - (length - fill[x]) < fill[x]:
                break  # the rest has no room for this bin, and so for none that holds more
            own = held[edges[0][at] : edges[1][at]]
            if tuple(sorted(sizes[own])) not in stuck:
                donor = x
                break
        if donor is None:
            return bins
        others = held[bins[held] != donor]
        emptied = _hand_on(sizes, bins, fill, donor, own, others, length)
        if emptied:
            stuck.clear()
        else:
            stuck.add(tuple(sorted(sizes[bins == donor])))


def _hand_on(sizes, bins, fill, donor, own, others, length) -> bool:
    """Exchange until the donor is empty or no step is left; changes ``bins`` and ``fill``."""
    own = list(own)

    def moved(given: list[int], taken: list[int], to: int) -> None:
        nonlocal others
        delta = int(sizes[given].sum() - sizes[taken].sum())
        bins[given], bins[taken] = to, donor
        fill[to] += delta
        fill[donor] -= delta
        for i in given:
            own.remove(i)
        own.extend(taken)
        others = others[bins[others] != donor]
        others = np.concatenate([others, np.array(given, others.dtype)])
        others = others[fill[bins[others]] < length]
        others = others[np.argsort(bins[others], kind="stable")]

    while own:
        target = others[fill[bins[others]] >= fill[donor]]
        room, held = length - fill[bins[target]], sizes[target]
        mine = sizes[own]
        step = _best(np.broadcast_to(mine[:, None], (len(mine), len(target))), room[None, :])
        if step:
            moved([own[step[0]]], [], bins[target[step[1]]])
            continue
        step = _best(mine[:, None] - held[None, :], room[None, :])
        if step:
            moved([own[step[0]]], [target[step[1]]], bins[target[step[1]]])
            continue
        for i in range(len(own) - 1):
            step = _best((mine[i] + mine[i + 1 :])[:, None] - held[None, :], room[None, :])
            if step:
                moved([own[i], own[i + 1 + step[0]]], [target[step[1]]], bins[target[step[1]]])
                break
        if step:
            continue
        left, right = _pairs_within(bins[target])
        two = held[left] + held[right]
        for i in range(len(own)):
            step = _best(mine[i] - two, room[left])
            if step:
                pair = [target[left[step[0]]], target[right[step[0]]]]
                moved([own[i]], pair, bins[pair[0]])
                break
        if not step:
            return False
    return True


def _search(length: int):
    """Task for one group: rows ``(bin, piece_row, length)``; a null bin is not packed yet."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece_row")
        sizes = group["length"].to_numpy(np.int64)
        rows = group["piece_row"].to_numpy(np.int64)
        old = group["bin"].to_numpy(np.float64 if group["bin"].isna().any() else np.int64)
        if np.isnan(old.astype(np.float64)).any():
            bins = best_fit(sizes, length)
        else:
            bins = np.unique(old, return_inverse=True)[1]
        bins = np.unique(local_search(sizes, bins, length), return_inverse=True)[1]
        fill = np.bincount(bins, weights=sizes)
        name = np.full(len(fill), np.iinfo(np.int64).max)
        np.minimum.at(name, bins, rows)  # a bin is named after its smallest piece
        return pd.DataFrame({
            "bin": name[bins], "piece_row": rows, "length": sizes, "open": fill[bins] < length,
        })

    return run


# --- all groups ------------------------------------------------------------------------


def packed(rows: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``(piece_row, sequence_id)`` for stored ``rows(piece_row, length)``.

    The whole pieces of a bin stay together when bins are dealt anew.
    """
    share_package(rows.sparkSession)
    full = rows.where(F.col("length") >= length).select("piece_row", F.col("piece_row").alias("sequence_id"))
    todo = rows.where(F.col("length") < length).select(F.lit(None).cast("long").alias("bin"), "piece_row", "length")
    done, turn, stalled, bins_before = [full], 0, 0, None
    while True:
        groups = max(1, -(-todo.count() // group_pieces))
        dealt = F.pmod(F.xxhash64(F.coalesce("bin", "piece_row"), F.lit(turn)), F.lit(groups))
        found = todo.withColumn("group", dealt).groupBy("group").applyInPandas(
            _search(length), "bin long, piece_row long, length long, open boolean"
        )
        found = stored(found, "packed")
        if groups == 1:
            return _all([*done, found.select("piece_row", F.col("bin").alias("sequence_id"))])
        done.append(found.where("NOT open").select("piece_row", F.col("bin").alias("sequence_id")))
        todo = found.where("open").select("bin", "piece_row", "length")
        bins, tokens, large = todo.agg(
            F.count_distinct("bin"), F.coalesce(F.sum("length"), F.lit(0)), F.count_if(F.col("length") > length // 2)
        ).first()
        stalled = stalled + 1 if bins_before is not None and bins >= bins_before else 0
        if bins <= max(-(-tokens // length), large) or stalled >= STALLED:
            return _all([*done, todo.select("piece_row", F.col("bin").alias("sequence_id"))])
        bins_before = bins
        turn += 1


def _all(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def pack(made: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows of :func:`pieces` with ``sequence_id`` and ``offset``, gapless from 0."""
    where = packed(made.select("piece_row", "length"), length)
    placed = made.join(where, "piece_row")
    before = Window.partitionBy("sequence_id").orderBy("piece_row").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def sequences(placed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` from packed pieces that carry their ids."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def packed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``(key, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece."""
    return pack(pieces(docs, key, text, path)).drop("piece_row").withColumnRenamed("key", key)
