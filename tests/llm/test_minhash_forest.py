import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.llm import minhash_forest as M
from labelmill.llm.components import components
from labelmill.session import stored
from tests.llm.cases import documents, none, prose, texts


def set_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) or frozenset([tuple(w)])


def roots_by_hand(sets, percent=85):
    """Root index of every set; quadratic."""
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both) and root[i] != root[j]:
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return root


def rows_by_hand(rows):
    sets = [set_by_hand(t) for _, t in rows]
    root = roots_by_hand(sets)
    least = {}
    for (key, _), r in zip(rows, root):
        if key is not None:
            least[r] = min(key, least.get(r, key))
    return Counter((k, len(s), least.get(r), k == least.get(r)) for (k, _), s, r in zip(rows, sets, root))


def as_rows(found):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found.collect())


def copies(n, seed, words=120, most=9):
    """Texts around one base, some of them too far from it for a link."""
    r = np.random.default_rng(seed)
    base = prose(seed, words).split()
    made = []
    for _ in range(n):
        w = list(base)
        for at in r.integers(0, len(w), r.integers(0, most)):
            w[at] = f"other{r.integers(0, 5)}"
        made.append(" ".join(w))
    return made


def small():
    short = ["a", "b a", "A", "a b", "a b c", "a b c d", " ".join("abcdefghi"), " ".join("abcdefgh"), " ".join("abcdefghij")]
    return [t for t in texts() if t is None or len(t) < 50_000] + short


@pytest.mark.parametrize("text", small())
def test_sets(text):
    assert len(M.shingle_hashes(text.encode() if text is not None else None)) == len(set_by_hand(text))


def test_signatures_agree_as_often_as_sets(spark):
    near = copies(30, 5, 300, 12)
    found = [M.signature(M.shingle_hashes(t.encode())) for t in near]
    for i in range(0, 30, 5):
        for j in range(i):
            a, b = set_by_hand(near[i]), set_by_hand(near[j])
            assert abs((found[i] == found[j]).mean() - len(a & b) / len(a | b)) < 0.2
    rows = [(i, [int(x) for x in M._joined(s[:, :3])], [int(x) for x in M._joined(s[:, 3:])]) for i, s in enumerate(found)]
    df = spark.createDataFrame(rows, "i int, first array<long>, rest array<long>")
    pairs = df.crossJoin(df.select(F.col("i").alias("j"), F.col("first").alias("f"), F.col("rest").alias("r")))
    for r in pairs.select("i", "j", M.agreeing("first", "rest", "f", "r").alias("n")).collect():
        assert r.n == (found[r.i] == found[r.j]).sum()


def test_table(spark):
    rows = list(enumerate(small() + copies(60, 1) + copies(20, 2, 900, 40) + copies(9, 3, 12, 2)))
    rows += [(0, rows[0][1]), (3, rows[0][1]), (None, rows[0][1]), (None, "only this one here"), (None, None), (7, "")]
    assert as_rows(M.near_duplicates(documents(spark, rows))) == rows_by_hand(rows)
    assert len(set(r.component_id for r in M.near_duplicates(documents(spark, rows)).collect())) < len(rows) - 40
    assert M.near_duplicates(none(spark)).count() == 0
    assert as_rows(M.near_duplicates(documents(spark, [(1, None), (2, " ")]))) == {(1, 0, 1, True): 1, (2, 0, 2, True): 1}


def reps_of(spark, made):
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    found = M.prints(df, "doc_id", "text", 3).where("digest IS NOT NULL")
    return df, stored(found.withColumn("rep", F.col("key")).drop("key"), "reps")


@pytest.mark.parametrize("region,hot,chunk", [(4, 10**6, 16), (4, 50, 1000), (2, 30, 7), (64, 10**6, 1000)])
def test_dense_regions_lose_no_link(spark, monkeypatch, region, hot, chunk):
    made = sorted(set(copies(150, 8, 200, 14) + copies(40, 9, 60, 5) + [prose(i, 50) for i in range(40)]))
    df, reps = reps_of(spark, made)
    monkeypatch.setattr(M, "HOT_REGIONS", 10**9)
    found = stored(M.links(df, reps, "doc_id", "text", 3, 85, region, hot, chunk), "links")
    root = {r.node: r.root for r in components(found).collect()}
    want = roots_by_hand([set_by_hand(t) for t in made])
    assert [root.get(i, i) for i in range(len(made))] == want
    assert 3 < len(set(want)) < len(made) - 40


def test_pairs_stay_few_in_a_dense_region(spark):
    made = sorted(set(copies(600, 4, 300, 3)))
    _, reps = reps_of(spark, made)
    assert M.candidates(reps).count() < 40 * len(made)


@pytest.mark.parametrize("seed", range(6))
def test_linked_is_transitive_and_whole(seed):
    made = copies(80, seed, 60, 2 + 4 * seed) + copies(5, 50, 30, 2)
    sets = [M.shingle_hashes(t.encode()) for t in made]
    assert M.linked(sets, 85).tolist() == roots_by_hand([set_by_hand(t) for t in made])


def test_recall_at_the_threshold():
    """Pairs at just the threshold share a region at full depth in some tree."""
    r = np.random.default_rng(1)
    missed = 0
    for _ in range(300):
        both, a, b = (r.integers(0, 2**63, n, dtype=np.uint64) for n in (850, 75, 75))
        x, y = M.signature(np.r_[both, a]), M.signature(np.r_[both, b])
        missed += not (x == y).all(1).any()
        assert (x == y).sum() >= M.least_agreeing(85)
    assert missed == 0
