"""Fill-in-the-middle: a text is cut at two units and its parts change places.

A unit is a word with the white space before it, or the white space at the end of a text, so the
units of a text joined together are the text. The units form an indexable skip list: every link
of every lane carries how many units and how many code points it passes, so a descent from the
top lane adds up widths until it stands exactly behind the wanted unit and knows the code point
there. A node's height follows from its number, so a text always gives the same list.

The cuts and the form follow from a hash of seed and key alone: a row that is computed again, on
another executor, gives the same output. A text is never cut at anything but its units, nor
shortened. Rows do not meet, so nothing is shuffled.

A null text counts as empty; empty texts and texts that contain one of the three marks stay
plain. A null key is hashed as an empty word. Repeated rows give the same output twice, other
columns pass through, those named like a result are replaced, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.words import share_package

SEED = 42
CHANGED = 50  # in a hundred texts
SUFFIX_FIRST = 80  # in a hundred changed texts
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
STEP = 8  # a lane has about one in this many nodes of the lane below
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


def unit_ends(text: str) -> np.ndarray:
    """Code points of ``text`` up to the end of every unit."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if len(points) == 0:
        return np.zeros(0, np.int64)
    space = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    ends = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
    return np.r_[ends, len(points)] if space[-1] else ends


class Lane(NamedTuple):
    units: np.ndarray  # of the link behind each node
    chars: np.ndarray
    below: np.ndarray  # each node's place in the lane below


class UnitList:
    """Indexable skip list over the units of a text; node 0 is the head, node i stands behind unit i."""

    def __init__(self, ends: np.ndarray) -> None:
        self.n = len(ends)
        chars = np.r_[0, ends]
        nodes = np.arange(self.n + 1)
        heights = _heights(self.n + 1)
        self.lanes: list[Lane] = []  # the lowest first
        below = nodes
        while True:
            self.lanes.append(Lane(np.diff(nodes), np.diff(chars[nodes]), below))
            if len(nodes) <= STEP:
                return
            below = np.flatnonzero(heights[nodes] > len(self.lanes))
            nodes = nodes[below]

    def chars_before(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        if not 0 <= rank <= self.n:
            raise IndexError(rank)
        units = chars = at = 0
        for level in range(len(self.lanes) - 1, -1, -1):
            lane = self.lanes[level]
            while at < len(lane.units) and units + lane.units[at] <= rank:
                units, chars, at = units + lane.units[at], chars + lane.chars[at], at + 1
            at = lane.below[at] if level else at
        assert units == rank
        return int(chars)


def _heights(n: int) -> np.ndarray:
    """Lanes of each node, drawn from its number; the head is in all."""
    x = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    low = x & (~x + np.uint64(1))  # the lowest bit set: 2 to the number of zeros below it
    zeros = np.zeros(n, np.int64)
    some = low > 0
    zeros[some] = np.round(np.log2(low[some].astype(np.float64))).astype(np.int64)
    heights = 1 + zeros // (STEP.bit_length() - 1)
    heights[0] = 64
    return heights


def draws(key: object, seed: int = SEED) -> list[int]:
    """Four unsigned 32-bit numbers that seed and key decide."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4)]


class Cut(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def rearranged(text: str | None, key: object, seed: int = SEED, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> Cut:
    text = text or ""
    ends = unit_ends(text)
    h1, h2, h3, h4 = draws(key, seed)
    if not text or h3 % 100 >= changed or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return Cut(len(ends), "plain", None, None, text)
    units = UnitList(ends)
    first, last = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    a, b = units.chars_before(first), units.chars_before(last)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return Cut(units.n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)))
    return Cut(units.n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED,
    changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """``docs`` with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    ``changed`` in a hundred texts change their form, ``suffix_first`` in a hundred of those put
    the suffix first. The lengths count code points and are null for plain texts.
    """
    share_package(docs.sparkSession)

    @F.pandas_udf(RESULT)
    def column(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for keys, texts in batches:
            made = [rearranged(t, k, seed, changed, suffix_first) for k, t in zip(keys, texts)]
            out = pd.DataFrame(made, columns=list(Cut._fields))
            yield out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    names = [f.strip().split()[0] for f in RESULT.split(",")]
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    found = docs.withColumn("__fim", column(F.col(key).cast("string"), F.col(text)))
    return found.select(*rest, *[F.col(f"__fim.{n}").alias(n) for n in names])


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of; the marks cannot occur in its parts."""
    parts = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))
