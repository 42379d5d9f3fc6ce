"""State kept by increments, stored sketches, and products in blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.operators import increments as I
from labelmill.operators import sketches as K
from labelmill.operators.blocked import score_blocked
from labelmill.operators.profiling import js_divergence, label_distribution


def papers(spark, n=300, seed=1):
    r = np.random.default_rng(seed)
    rows = [(str(i), [["a", "b", "c", None][j] for j in r.integers(0, 4, r.integers(0, 4))], ["train", "val"][int(r.random() < 0.3)])
            for i in range(n)]
    return spark.createDataFrame(rows, "id string, labels array<string>, split string")


def counts(df):
    return sorted((r["split"], r["label"], r["count"]) for r in df.collect())


def recount(df):
    return counts(label_distribution(df, "labels", ("split",)).where("label IS NOT NULL"))


def test_three_batches_equal_the_recount(spark, tmp_path):
    state, every = str(tmp_path / "state"), papers(spark)
    assert I.profile(spark, state).count() == 0
    parts = [every.where(F.crc32("id") % 3 == i) for i in range(3)]
    for i, part in enumerate(parts):
        I.land(part, state, f"b{i}")
    assert counts(I.profile(spark, state)) == recount(every)
    assert {r.split: r.papers for r in I.papers_per_split(spark, state).collect()} == {
        r.split: r["count"] for r in every.groupBy("split").count().collect()}
    I.land(parts[1], state, "b1")  # a replay
    assert counts(I.profile(spark, state)) == recount(every)
    gone = parts[2].where("id < '2'")
    I.land(gone, state, "gone", retract=True)
    left = every.join(gone.select("id"), "id", "left_anti")
    assert counts(I.profile(spark, state)) == recount(left)
    drift = {(r.split_a, r.split_b): r.js_divergence for r in I.drift(spark, state).collect()}
    want = {(r.split_a, r.split_b): r.js_divergence for r in js_divergence(label_distribution(left, "labels", ("split",)).where("label IS NOT NULL")).collect()}
    assert drift == pytest.approx(want)
    I.merge_batches(spark, state, "all")
    assert list(I.batches(spark, state)) == ["all"] and counts(I.profile(spark, state)) == recount(left)
    assert len([p for p in (tmp_path / "state").iterdir() if p.is_dir()]) == 1
    I.withdraw(spark, state, "all")
    assert I.profile(spark, state).count() == 0


def test_a_landing_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    state, every = str(tmp_path / "state"), papers(spark, 40)
    I.land(every, state, "b0")

    def dies(*_):
        raise OSError("gone")

    monkeypatch.setattr(I, "write_document", dies)
    with pytest.raises(OSError):
        I.land(every.limit(3), state, "b0")
    with pytest.raises(OSError):
        I.merge_batches(spark, state, "x")
    monkeypatch.undo()
    assert counts(I.profile(spark, state)) == recount(every)
    assert len(I.sweep(spark, state)) == 2 and counts(I.profile(spark, state)) == recount(every)


def test_empty_and_odd_batches(spark, tmp_path):
    state = str(tmp_path / "state")
    I.land(papers(spark, 5).limit(0), state, "a batch/with: odd name")
    assert I.profile(spark, state, True).count() == 0
    rows = spark.createDataFrame([("1", None, "train"), ("1", ["a"], None)], "id string, labels array<string>, split string")
    I.land(rows, state, "odd")
    assert sorted(map(str, I.profile(spark, state, True).collect())) == sorted(map(str, [
        *spark.createDataFrame([("train", "", 1), (None, "", 1), (None, "a", 1)], "split string, label string, count long").collect()]))


@pytest.mark.parametrize("k", [200, 1000])
def test_merged_sketches_stay_within_their_bound(spark, k):
    df = spark.range(60_000).select(
        (F.col("id") % 7).alias("day"), F.when(F.col("id") % 5 == 0, "val").otherwise("train").alias("split"),
        F.floor(F.exp(F.rand(3) * 8)).cast("int").alias("v")).cache()
    kept = K.sketched(df, "v", ("split", "day"), k)
    values = {s: np.sort([r.v for r in df.where(F.col("split") == s).collect()]) for s in ("train", "val")}
    for p in (0.05, 0.5, 0.95):
        found = K.length_summary(K.merged(kept, ("split", "day")), ("split",), p)
        for r in found.collect():
            own = values[r.split]
            assert (r.n, r.least, r.most) == (len(own), own[0], own[-1]) and r.mean == pytest.approx(own.mean())
            low, high = np.searchsorted(own, r.quantile, "left") / len(own), np.searchsorted(own, r.quantile, "right") / len(own)
            assert low - K.rank_error(k) <= p <= high + K.rank_error(k)
        bounds = K.rank_bounds(df, "v", found, ("split",)).collect()
        assert all(b.below - K.rank_error(k) <= p <= b.upto + K.rank_error(k) for b in bounds)
    whole = K.rank_bounds(df, "v", K.length_summary(kept, (), 0.5), ()).first()
    assert whole.below - K.rank_error(k) <= 0.5 <= whole.upto + K.rank_error(k)
    everything = K.merged(kept).select("n", K.quantile(0.5).alias("m"), K.rank(F.lit(10**9)).alias("r")).first()
    assert everything.n == 60_000 and everything.r == 1.0
    assert K.length_summary(kept.limit(0)).count() == 0
    none = spark.createDataFrame([(None,)], "v int").withColumn("split", F.lit("x"))
    assert K.sketched(none, "v", ("split",)).count() == 0
    df.unpersist()


def test_products_in_blocks(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(37, 11))
    labels = [5, 10**6, 7, 3_000_000_000, 12, 9, 8]
    w = {(c, d): r.normal() for c in labels for d in range(11) if r.random() < 0.8}
    vectors = spark.createDataFrame([(i % 30, [float(x) for x in v[i]]) for i in range(37)] + [(99, None), (98, [None, 1.0])], "k int, v array<double>")
    weights = spark.createDataFrame([(c, d, x) for (c, d), x in w.items()] + [(None, 0, 1.0), (5, 2, None)], "label long, dim int, x double")
    want = sorted([(i % 30, c, round(sum(v[i][d] * w.get((c, d), 0) for d in range(11)), 9)) for i in range(37) for c in labels]
                  + [(99, c, 0.0) for c in labels] + [(98, c, round(w.get((c, 1), 0.0), 9)) for c in labels])
    for sizes in ({}, {"rows": 5, "classes": 3, "dims": 4}, {"rows": 100, "classes": 1, "dims": 11}):
        got = score_blocked(vectors, weights, "k", **sizes).collect()
        assert sorted((r.k, r.label, round(r.score, 9)) for r in got) == want
    assert score_blocked(vectors.limit(0), weights, "k").count() == 0
    assert score_blocked(vectors, weights.limit(0), "k").count() == 0


def test_sparse_labels_are_plugged_in(spark, tmp_path):
    from labelmill.registry.model_queries import plugged

    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=4)], [0, 10**6, 17][i % 3]) for i in range(20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    one = {(x.vec_id, x.idx): x.logit for x in plugged(spark, str(tmp_path), 8).collect()}
    blocks = {(x.vec_id, x.idx): x.logit for x in plugged(spark, str(tmp_path), 8, one_matrix=2, classes=2).collect()}
    assert set(one) == set(blocks) == {(i, c) for i in range(20) for c in (0, 17, 10**6)}
    assert all(one[x] == pytest.approx(blocks[x]) for x in one)
