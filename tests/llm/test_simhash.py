import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from labelmill.llm import simhash as S
from labelmill.llm.components import components
from tests.llm.cases import documents, none, prose, texts


def print_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_by_hand(prints, radius=3):
    """Root index of every print; quadratic."""
    root = list(range(len(prints)))
    p = np.array(prints, np.uint64)
    for i in range(len(p)):
        for j in np.flatnonzero(np.bitwise_count(p ^ p[i]) <= radius):
            a, b = root[i], root[int(j)]
            if a != b:
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def near_copies(n, seed=1):
    r = np.random.default_rng(seed)
    base = prose(seed, 400).split()
    made = []
    for _ in range(n):
        w = list(base)
        for i in r.integers(0, len(w), r.integers(0, 4)):
            w[i] = "changed" + str(i % 7)
        made.append(" ".join(w))
    return made


@pytest.mark.parametrize("text", [t for t in texts() if t is None or len(t) < 5000] + ["\x1c a\x0bb\x0cc\x85d"])
def test_fingerprint(text):
    got = S.simhash(text.encode() if text is not None else None)
    assert got % 2**64 == print_by_hand(text)


def test_fingerprint_in_chunks(monkeypatch):
    text = prose(9, 500).encode()
    whole = S.simhash(text)
    monkeypatch.setattr(S, "_CHUNK", 7)
    assert S.simhash(text) == whole


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 300, 700])
@pytest.mark.parametrize("radius", [1, 3, 6])
def test_blocks_find_every_pair(n, radius):
    r = np.random.default_rng(n)
    p = r.integers(0, 2**64, max(1, n // 20), dtype=np.uint64)[r.integers(0, max(1, n // 20), n)]
    for _ in range(radius + 1):
        p ^= np.where(r.random(n) < 0.6, np.uint64(1) << r.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    found = set()
    for a, b in S.close_pairs(p, np.full(n, n), radius):
        found |= set(zip(a.tolist(), b.tolist()))
    far = np.bitwise_count(p[:, None] ^ p[None, :])
    assert found == {(i, j) for i, j in zip(*np.nonzero(far <= radius)) if i < j}


def check(spark, docs):
    rows = docs.collect()
    prints = [print_by_hand(r.text) for r in rows]
    root = groups_by_hand(prints)
    least = {}
    for r, g in zip(rows, root):
        if r.doc_id is not None:
            least[g] = min(r.doc_id, least.get(g, r.doc_id))
    want = Counter((r.doc_id, f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, root))
    out = S.near_duplicates(docs).withColumn("h", S.hex_of("fp"))
    assert Counter((r.doc_id, r.h, r.component_id) for r in out.collect()) == want
    return len(set(root))


def small():
    return [t for t in texts() if t is None or len(t) < 5000] + near_copies(40) + ["", "a", "a b", "b a"]


def test_components(spark):
    docs = documents(spark, list(enumerate(small())) + [(3, small()[0]), (None, small()[0]), (None, "only this one")])
    assert check(spark, docs) < 60
    assert S.near_duplicates(none(spark)).count() == 0


@pytest.mark.parametrize("limit", [2, 5, 12])
def test_large_buckets_are_cut_without_loss(spark, monkeypatch, limit):
    r = np.random.default_rng(5)
    base = np.uint64(0x0123456789ABCDEF)
    p = np.full(150, base)
    for _ in range(5):
        p ^= np.uint64(1) << r.integers(0, 64, 150).astype(np.uint64)
    p = np.unique(np.r_[p, r.integers(0, 2**64, 50, dtype=np.uint64)])
    df = spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "fp long")
    edges = S.links(df, 3, limit).collect()
    assert all(bin((e.a ^ e.b) % 2**64).count("1") >= 1 for e in edges)
    root = {int(x): int(x) for x in p.view(np.int64)}
    for e in edges:
        a, b = root[e.a], root[e.b]
        root = {k: (min(a, b) if v in (a, b) else v) for k, v in root.items()}
    got = Counter(root[int(x)] for x in p.view(np.int64)).values()
    want = Counter(groups_by_hand(p.tolist())).values()
    assert sorted(got) == sorted(want)


def test_one_row_of_each_group_stays(spark):
    found = small()
    docs = documents(spark, list(enumerate(found)) + [(0, found[0]), (None, found[0]), (None, "never seen before"), (None, "never seen before")])
    rows = docs.collect()
    root = groups_by_hand([print_by_hand(r.text) for r in rows])
    best = {}
    for r, g in zip(rows, root):
        key = (r.doc_id is None, r.doc_id or 0)
        best[g] = min(key, best.get(g, key))
    out = S.one_of_each(docs)
    assert out.columns == docs.columns
    got = Counter((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    assert got == Counter(best.values())
    assert S.one_of_each(none(spark)).count() == 0


def test_star_components(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 5), (7, 7), (5, 2), (900, 100)]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {found[i] for i in [*range(100, 161), 900]} == {100}
    assert {found[i] for i in (2, 5, 9)} == {2} and 7 not in found
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
