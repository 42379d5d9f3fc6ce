import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelmill.llm import periodic_runs as P
from labelmill.llm.registered import op12_periodic_runs
from tests.llm.cases import documents, none, prose, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_by_hand(words, least=24, exponent=3):
    """Every period tried at every place."""
    w, found = np.array(words), {}
    for q in range(1, len(w) // exponent + 1):
        same = np.r_[False, w[q:] == w[:-q], False]
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2], edges[1::2]):
            length = int(b - a + q)
            if length >= max(least, exponent * q):
                found.setdefault((int(a), length), q)
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def repeated_by_hand(key, words):
    h = zlib.crc32(b"" if key is None else str(key).encode())
    n, g = len(words), h // 10
    if h % 10 or n == 0:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def collapsed_by_hand(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def row_by_hand(key, text):
    words = repeated_by_hand(key, WORD.findall(text or ""))
    runs = runs_by_hand(words)
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    kept = " ".join(collapsed_by_hand(words, runs))
    return (key, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def as_rows(found):
    return [tuple(int(x) for x in row) for row in found]


SMALL = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 9)), max_size=6)


def nested(parts):
    return [x for word, times in parts for x in word * times]


@settings(max_examples=400, deadline=None)
@given(SMALL, st.integers(1, 4), st.sampled_from([(24, 3), (6, 3), (3, 3), (12, 4)]))
def test_any_text_of_few_words(parts, times, limits):
    words = np.array(nested(parts) * times, np.int64)
    assert as_rows(P.runs_of([words], *limits)[0]) == runs_by_hand(words, *limits)


@settings(max_examples=150, deadline=None)
@given(st.lists(SMALL, min_size=1, max_size=6))
def test_texts_do_not_mix(many):
    given_ = [np.array(nested(parts) * 2, np.int64) for parts in many]
    got = P.runs_of(given_, 6, 3)
    assert [as_rows(g) for g in got] == [runs_by_hand(w, 6, 3) for w in given_]


@pytest.mark.parametrize("root", ["a", "ab", "aab", "a" * 30 + "b", "aab" * 9 + "b", "abaababaabaab", "a" * 63 + "b" + "a" * 5 + "c", "ab" * 40 + "c" + "ab" * 37 + "d"])
@pytest.mark.parametrize("times", [3, 4, 9])
def test_runs_of_periodic_roots(root, times):
    for before, after in (("", ""), ("xy", "z"), (root[3:] + "q", root[:5])):
        words = np.array([ord(c) for c in before + root * times + after + "!" + root * 3], np.int64)
        assert as_rows(P.runs_of([words])[0]) == runs_by_hand(words)


def test_fibonacci_and_powers():
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    for words in (b, [0] * 5000, [0, 1] * 2500, list(range(700)) * 4, ([0] * 99 + [1]) * 40):
        words = np.array(words, np.int64)
        assert as_rows(P.runs_of([words])[0]) == runs_by_hand(words)
        assert as_rows(P.runs_of([words], 6, 3)[0]) == runs_by_hand(words, 6, 3)


def test_no_run_is_put_aside():
    r = np.random.default_rng(2)
    given_ = []
    for i in range(200):
        root = r.integers(0, 3 + i, r.integers(1, 60))
        given_.append([b"%d" % x for x in np.r_[r.integers(0, 9999, 40), np.resize(root, r.integers(1, 4 * len(root) + 30)), r.integers(0, 9999, 9)]])
    found = P._group(given_, 24, 3)
    assert [as_rows(f) for f in found] == [runs_by_hand(w) for w in given_]
    assert 20 < sum(len(f) > 0 for f in found) < 200


def test_successors():
    r = np.random.default_rng(0)
    for n in (1, 2, 7, 64, 1000):
        values = r.permutation(n)
        tree = P.WaveletTree(values)
        low = r.integers(0, n + 1, 300)
        high = np.maximum(low, r.integers(0, n + 1, 300))
        bound = r.integers(0, n + 3, 300)
        want = [min((v for v in values[a:b] if v >= x), default=n) for a, b, x in zip(low, high, bound)]
        assert tree.successor(low, high, bound, n).tolist() == want


def test_common_stretches():
    words = np.array([0, 1, 0, 1, 0, 0, 1, 0, 1, 1, 9])
    blocks = P.Blocks(words)
    for i in range(10):
        for j in range(i + 1, 10):
            ahead = next((k for k in range(10) if words[i + k] != words[j + k]), None)
            before = next((k for k in range(1, 11) if i - k < 0 or words[i - k] != words[j - k]), None) - 1
            assert blocks.common_ahead(np.array([i]), np.array([j]))[0] == ahead
            assert blocks.common_before(np.array([i]), np.array([j]))[0] == before


def many():
    r = np.random.default_rng(3)
    made = []
    for i in range(120):
        base = prose(i, int(r.integers(0, 120))).split()
        root = prose(1000 + i, int(r.integers(1, 30))).split()
        made.append(" ".join(base + root * int(r.integers(1, 7)) + root[: int(r.integers(0, len(root) + 1))] + base[:9]))
    return [t for t in texts() if t is None or len(t) < 50_000] + made


def test_table(spark):
    rows = list(enumerate(many())) + [(3, "again"), (None, "x y " * 30), (None, None)]
    out = P.periodic_runs(documents(spark, rows))
    assert sorted(out.columns) == sorted([*documents(spark, rows).columns, "runs", "collapsed"])
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=repr)
    want = []
    for key, text in rows:
        words = WORD.findall(text or "")
        runs = runs_by_hand(words)
        want.append((key, runs, " ".join(collapsed_by_hand(words, runs))))
    assert got == sorted(want, key=repr)
    assert sum(len(g[1]) > 0 for g in got) > 30
    assert P.periodic_runs(none(spark)).count() == 0
    with pytest.raises(ValueError):
        P.periodic_runs(documents(spark), min_exponent=2)


def test_query(spark, tmp_path):
    rows = list(enumerate(many())) + [(i, t) for i, t in enumerate(many(), 2000)] + [(None, "a b " * 20), (None, None)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = op12_periodic_runs(spark, str(tmp_path))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted((row_by_hand(k, t) for k, t in rows), key=repr)
    assert sum(g[1] > 0 for g in got) > 60


def test_long_text():
    words = [b"w%d" % (i % 9973) for i in range(400_000)]
    found = P.found_in([b" ".join(words)])
    assert found.starts[0].tolist() == [0] and found.periods[0].tolist() == [9973]
