"""Periodic runs of words, found by internal pattern matching on dyadic blocks.

A run is a stretch of words with smallest period ``q`` and at least ``min_exponent`` periods and
``min_words`` words, which no word beside it extends. Every run contains a block of ``B = 2^k``
words, aligned to a multiple of ``B``, that occurs again ``q`` words later, with ``q < 2 B``: the
largest ``B`` with ``2 B - 1 <= length - q`` is enough, and it is more than half of ``q``. So the
occurrences of every aligned block in the windows behind it hold all periods.

They are asked for one after another: a block's occurrences are an interval of the suffix array,
and the next one at or behind a place is a range successor in a wavelet tree over that array.
Occurrences at most ``B / 2`` apart form a progression: the block then repeats with that step, and
instead of each member the stretches of that step are compared, whose beginnings and ends are a
period of a longer run apart. That leaves a handful of questions per block. A candidate period is
extended to both sides by the ranks of dyadic blocks and judged exactly.

A text without two equal windows of ``min_words - min_words / min_exponent`` words has no run; such
texts are put aside by hashes (which never put aside another). The rest of a batch is laid into
one array, each text behind a separator of its own, so many short texts cost as much as a long one.
Texts are read whole; a text stays in one task, whose memory grows with its longest text.

Null and empty texts have no words and no runs. Repeated rows are treated alike, other columns pass
through, those named like a result are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.words import share_package, spaced_words

MIN_WORDS = 24
MIN_EXPONENT = 3
GROUP_WORDS = 1 << 18  # words laid into one array; a longer text has its own
RESULT = "starts array<long>, lengths array<long>, periods array<long>, collapsed string"

# --- dictionary of dyadic blocks, suffix array, wavelet tree ---------------------------------


class Blocks:
    """Ranks of all blocks of 1, 2, 4, ... words of an array that ends in a word of its own.

    A block's rank is the first place of its occurrences in the suffix array.
    """

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        self.ranks: list[np.ndarray] = []
        self.firsts: list[np.ndarray] = []
        key, step = words.astype(np.int64), 1
        while True:
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            first = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
            rank = np.empty(n, np.int32)
            rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
            if len(first) == n:
                self.suffixes = order
                return
            self.ranks.append(rank)
            self.firsts.append(np.r_[first, n])
            behind = np.zeros(n, np.int64)
            behind[: max(0, n - step)] = rank[step:].astype(np.int64) + 1
            key, step = rank.astype(np.int64) * (n + 1) + behind, 2 * step

    def occurrences(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of the suffix array with the occurrences of the block of ``2^level`` words."""
        low = self.ranks[level][at].astype(np.int64)
        firsts = self.firsts[level]
        return low, firsts[np.searchsorted(firsts, low, "right")]

    def common_ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that begins at both places."""
        length = np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            same = self.ranks[level][a + length] == self.ranks[level][b + length]
            length += same.astype(np.int64) << level
        return length

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same for stretches that end before both places; ``a < b``."""
        length = np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            i, j = a - length - (1 << level), b - length - (1 << level)
            inside = i >= 0
            same = inside & (self.ranks[level][np.where(inside, i, 0)] == self.ranks[level][np.where(inside, j, 0)])
            length += same.astype(np.int64) << level
        return length


class WaveletTree:
    """Over an array of numbers: the smallest number at or above a bound within an interval."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros_before: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~one, out=before[1:])
            self.zeros_before.append(before)
            values = np.r_[values[~one], values[one]]

    def _below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        count = np.zeros(len(low), np.int64)
        for bit, before in zip(range(self.bits - 1, -1, -1), self.zeros_before):
            zeros, a, b = before[-1], before[low], before[high]
            one = (bound >> bit) & 1 == 1
            count += np.where(one, b - a, 0)
            low, high = np.where(one, low - a + zeros, a), np.where(one, high - b + zeros, b)
        return count

    def successor(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray, none: int) -> np.ndarray:
        """For every interval the smallest number that is at least ``bound``, or ``none``."""
        bound = np.minimum(bound, (1 << self.bits) - 1)
        place = self._below(low, high, bound)
        found = place < high - low
        low, high, place = low[found], high[found], place[found]
        value = np.zeros(len(low), np.int64)
        for bit, before in zip(range(self.bits - 1, -1, -1), self.zeros_before):
            zeros, a, b = before[-1], before[low], before[high]
            one = place >= b - a
            value += one.astype(np.int64) << bit
            place = np.where(one, place - (b - a), place)
            low, high = np.where(one, low - a + zeros, a), np.where(one, high - b + zeros, b)
        out = np.full(len(found), none, np.int64)
        out[found] = value
        return out


# --- candidates and runs ---------------------------------------------------------------------


def _candidates(blocks: Blocks, tree: WaveletTree, begins: np.ndarray, ends: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """``(place, period)`` from all aligned blocks of one size."""
    size = 1 << level
    fit = (ends - begins) // size
    text = np.repeat(np.arange(len(begins)), fit)
    number = np.arange(len(text)) - np.repeat(np.cumsum(fit) - fit, fit)
    at = begins[text] + number * size
    limit = np.minimum(at + 2 * size, ends[text] - size)
    low, high = blocks.occurrences(level, at)
    again = high - low > 1
    at, limit, low, high = at[again], limit[again], low[again], high[again]
    bound, last = at + 1, at.copy()
    step, left, right = np.zeros_like(at), np.zeros_like(at), np.zeros_like(at)
    places, periods = [], []

    def stretch(of: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return of - blocks.common_before(of, of + by), of + by + blocks.common_ahead(of, of + by)

    while len(at):
        found = tree.successor(low, high, bound, len(blocks.suffixes))
        inside = found <= limit
        at, limit, low, high, last, step, left, right, found = (
            x[inside] for x in (at, limit, low, high, last, step, left, right, found)
        )
        places.append(at)
        periods.append(found - at)
        news = (step == 0) & (found - last <= size // 2)
        if news.any():
            step[news] = (found - last)[news]
            left[news], right[news] = stretch(at[news], step[news])
        bound = found + 1
        stepping = step > 0
        own = stepping & (found + size <= right)
        bound[own] = right[own] - size + 1
        other = stepping & ~own
        if other.any():
            begin, end = stretch(found[other], step[other])
            places += [at[other], at[other]]
            periods += [begin - left[other], end - right[other]]
            bound[other] = end - size + 1
        last = found
    if not places:
        return at, at
    places, periods = np.concatenate(places), np.concatenate(periods)
    return places[periods > 0], periods[periods > 0]


def runs_of(texts: list[np.ndarray], min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[np.ndarray]:
    """For every text, given as numbers of words, rows ``(start, length, period)`` by start, then period."""
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    if sizes.sum() == 0:
        return out
    # Each text is followed by a number that stands nowhere else.
    top = 1 + max(int(t.max()) for t in texts if len(t))
    words = np.concatenate([x for i, t in enumerate(texts) for x in (t, [top + i])])
    begins = np.cumsum(sizes + 1) - sizes - 1
    ends = begins + sizes
    blocks = Blocks(words)
    tree = WaveletTree(blocks.suffixes)
    # A run of l words has its block at the largest B with 2 B - 1 <= l - q, and l - q is least for the shortest.
    least = (min_words - min_words // min_exponent + 1) // 2
    found = [
        _candidates(blocks, tree, begins, ends, level)
        for level in range(least.bit_length() - 1, len(blocks.ranks))
    ]
    if not found:
        return out
    place, period = (np.concatenate(x) for x in zip(*found))
    inside = place + period < len(words)
    place, period = place[inside], period[inside]
    start = place - blocks.common_before(place, place + period)
    length = place + period + blocks.common_ahead(place, place + period) - start
    whole = (length >= min_words) & (length >= min_exponent * period)
    rows = np.unique(np.stack([start[whole], length[whole], period[whole]], axis=1), axis=0)
    # The same stretch with a multiple of its period is no other run.
    rows = rows[np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)])] if len(rows) else rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    text = np.searchsorted(begins, rows[:, 0], "right") - 1
    rows[:, 0] -= begins[text]
    for i in np.unique(text):
        out[i] = rows[text == i]
    return out


def _may_repeat(words: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """Owners with two windows of one hash; equal windows always have one."""
    h = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    h ^= h >> np.uint64(29)
    size, factor = 1, 0xBF58476D1CE4E5B9
    while size < window:  # windows of 2, 4, ... words, the last overlapping itself
        shift = min(size, window - size)
        if len(h) <= shift:
            return np.zeros(0, np.int64)
        h = (h[:-shift] * np.uint64(factor)) ^ h[shift:]
        size, factor = size + shift, factor * 0x94D049BB133111EB % 2**64
    inside = owner[: len(h)] == owner[window - 1 :]
    h, owner = h[inside], owner[: len(h)][inside]
    order = np.argsort(h, kind="stable")  # keeps windows of one owner together
    h, owner = h[order], owner[order]
    return np.unique(owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])])


def _group(texts: list[list[bytes]], min_words: int, min_exponent: int) -> list[np.ndarray]:
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    if sizes.max(initial=0) < min_words:
        return out
    every = np.empty(int(sizes.sum()), object)
    every[:] = [w for t in texts for w in t]
    numbers = pd.factorize(every)[0].astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    some = _may_repeat(numbers, owner, max(1, min_words - min_words // min_exponent))
    ends = np.cumsum(sizes)
    found = runs_of([numbers[ends[i] - sizes[i] : ends[i]] for i in some], min_words, min_exponent)
    for i, rows in zip(some, found):
        out[i] = rows
    return out


def _collapsed(words: list[bytes], runs: np.ndarray) -> str:
    if len(runs) == 0:
        return b" ".join(words).decode()
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
    return b" ".join([words[i] for i in kept]).decode()


def found_in(texts: list[bytes | None], min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> pd.DataFrame:
    """Runs and collapsed text of every text, in groups of bounded size."""
    rows: list[tuple] = []
    group: list[list[bytes]] = []

    def close() -> None:
        for words, runs in zip(group, _group(group, min_words, min_exponent)):
            rows.append((runs[:, 0], runs[:, 1], runs[:, 2], _collapsed(words, runs)))
        group.clear()

    n = 0
    for text in texts:
        words = text.split() if text else []  # bytes know ASCII white space only, as wanted
        if group and n + len(words) > GROUP_WORDS:
            close()
            n = 0
        group.append(words)
        n += len(words)
    close()
    return pd.DataFrame(rows, columns=["starts", "lengths", "periods", "collapsed"])


def periodic_runs(
    docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """``docs`` with ``runs`` (start, length and period, by start, then period) and ``collapsed``.

    ``collapsed`` is the text's words joined by a space without those that a run repeats: what a run
    holds after its first period goes.
    """
    if min_exponent < 3 or min_words < min_exponent:
        raise ValueError("runs of fewer than three periods are not looked for")
    share_package(docs.sparkSession)

    @F.pandas_udf(RESULT)
    def column(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield found_in(list(batch), min_words, min_exponent)

    found = docs.withColumn("__runs", column(F.col(text).cast("binary")))
    run = F.transform(F.arrays_zip("__runs.starts", "__runs.lengths", "__runs.periods"), lambda r: F.struct(
        r["starts"].alias("start"), r["lengths"].alias("length"), r["periods"].alias("period")
    ))
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    return found.select(*rest, run.alias("runs"), F.col("__runs.collapsed").alias("collapsed"))


def longest_by_exponent(runs: str | Column = "runs") -> Column:
    """Of an array of runs the one with most periods; the first of equal ones, null of none."""
    runs = F.col(runs) if isinstance(runs, str) else runs

    def better(best: Column, run: Column) -> Column:
        return F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best)

    return F.aggregate(runs, F.get(runs, F.lit(0)), better)


def with_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with a known periodic tail in a tenth of the texts, which a hash of the key names.

    The tail of such a text, from a word that the hash names too, is its own first words over and
    over, three to ten times. For trials of recall over whole tables. A null key is hashed as an
    empty word; a text without words becomes empty.
    """
    h = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")))
    words = docs.withColumn("__words", F.when(F.pmod(h, F.lit(10)) == 0, spaced_words(F.col(text))))
    n, g = F.size("__words"), F.floor(h / 10)
    a = F.when(n > 0, F.pmod(g, n)).otherwise(F.lit(0)).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("__words", a + 1, p), times)), F.lit(1), n - a)
    made = F.array_join(F.concat(F.slice("__words", F.lit(1), a), tail), " ")
    return words.withColumn(text, F.when(F.col("__words").isNull(), F.col(text)).otherwise(made)).drop("__words")
