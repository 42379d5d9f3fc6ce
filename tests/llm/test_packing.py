import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelmill.llm import packing as P
from tests.llm.cases import documents, none, texts

PATH = P.default_vocabulary()


def exact_ids(text):
    return P._exact(PATH).encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_those_of_the_tokenizer(text):
    assert P.token_ids(text, PATH) == exact_ids(text)


@pytest.mark.parametrize("text", [
    "<|endoftext|>", "a<|endoftext|> b <|endoftext|>", "x" * 20_000, " " * 3000, "\r\n\t \u00a0\u2003x", "don't WON'T I'll",
    "é\u0301 漢字 \U0001f600 ½ ² ٣ १२", "1234567 12.5e9", "<|endof", "\x00\x1c\x85", "_a_b__c",
])
def test_ids_of_odd_texts(text):
    assert P.token_ids(text, PATH) == exact_ids(text)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 16, 17, 24])
def test_cut(n):
    made = P.cut(n, 8)
    assert [s for s, _ in made] == [sum(x for _, x in made[:i]) for i in range(len(made))]
    assert sum(x for _, x in made) == n and all(x == 8 for _, x in made[1:]) and 0 < made[0][1] <= 8
    assert len(made) == -(-n // 8)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 31), min_size=1, max_size=60))
def test_search_never_gets_worse(sizes):
    s = np.array(sizes)
    bins = P.best_fit(s, 32)
    better = P.local_search(s, bins, 32)
    fill = lambda b: np.bincount(np.unique(b, return_inverse=True)[1], weights=s)
    assert fill(better).max() <= 32 and fill(better).sum() == s.sum()
    assert len(fill(better)) <= len(fill(bins)) and (fill(better) ** 2).sum() >= (fill(bins) ** 2).sum()


def test_exchanges_empty_a_bin():
    # Two for one and one for one: 6+6+6 fit 2 bins of 10 only after swaps.
    sizes = np.array([7, 4, 4, 2, 2, 1])
    bins = np.array([0, 1, 1, 2, 2, 2])
    assert len(np.unique(P.local_search(sizes, bins, 10))) == 2


def test_search_gains_over_best_fit():
    sizes = np.random.default_rng(0).integers(200, 420, 3000)
    start = P.best_fit(sizes, 1024)
    better = P.local_search(sizes, start, 1024)
    least = -(-sizes.sum() // 1024)
    assert len(np.unique(better)) - least < 0.5 * (start.max() + 1 - least)


def check(docs, placed, length):
    want = sorted(
        (r.doc_id is None, r.doc_id or 0, tuple(P.token_ids(r.text, PATH) + [P.END])) for r in docs.collect()
    )
    rows = placed.collect()
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    ids = {}
    for r in rows:
        if r.piece == 0:
            ids.setdefault((r.doc_id is None, r.doc_id or 0), []).append(r)
    total = sum(len(x[2]) for x in want)
    assert sum(r.length for r in rows) == total
    crcs = sorted((a, b, zlib.crc32(np.array(part[s : s + n], "<u4").tobytes()))
                  for a, b, part in want for s, n in P.cut(len(part), length))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids_crc32) for r in rows) == crcs
    return len(by_sequence), -(-total // length)


def test_documents(spark):
    docs = documents(spark)
    used, least = check(docs, P.packed_documents(docs), P.LENGTH)
    assert used <= least + 1
    assert P.packed_documents(none(spark)).count() == 0


def test_many_groups_meet_again(spark):
    rng = np.random.default_rng(1)
    sizes = rng.integers(200, 700, 1500).tolist()
    rows = spark.createDataFrame(list(enumerate(sizes)), "piece_row long, length long")
    placed = P.packed(rows, 1024, group_pieces=200).collect()
    fill = defaultdict(int)
    for r in placed:
        fill[r.sequence_id] += sizes[r.piece_row]
    assert len(placed) == 1500 and max(fill.values()) <= 1024
    alone = P.local_search(np.array(sizes), P.best_fit(np.array(sizes), 1024), 1024)
    assert len(fill) <= 1.02 * len(np.unique(alone)) + 2


@pytest.mark.parametrize("low,high", [(513, 1024), (340, 700), (1, 1024)])
def test_dealing_ends_at_the_least_or_when_nothing_moves(spark, low, high):
    sizes = np.random.default_rng(low).integers(low, high, 400)
    rows = spark.createDataFrame(list(enumerate(sizes.tolist())), "piece_row long, length long")
    placed = P.packed(rows, 1024, group_pieces=40).collect()
    fill = defaultdict(int)
    for r in placed:
        fill[r.sequence_id] += int(sizes[r.piece_row])
    assert len(placed) == 400 and max(fill.values()) <= 1024
    least = max(-(-int(sizes.sum()) // 1024), int((sizes > 512).sum()))
    alone = len(np.unique(P.local_search(sizes, P.best_fit(sizes, 1024), 1024)))
    assert least <= len(fill) <= max(alone, least) + 3  # groups that never met would leave a bin each


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame(list(enumerate(texts()[:12])), "doc_id int, text string")
    placed = P.pack(P.pieces(docs, with_ids=True))
    made = {r.sequence_id: r.ids for r in P.sequences(placed).collect()}
    for r in placed.collect():
        assert made[r.sequence_id][r.offset : r.offset + r.length] == r.ids
