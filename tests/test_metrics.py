import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.operators import metrics as M
from labelmill.operators.linear_model import pos_weight, pos_weight_summary, pos_weight_vector
from labelmill.operators.tuning import best_thresholds, pr_curve, tune

NAMES = ["a", "b", "c", "d"]


def frame(spark, y, p, parts=3):
    rows = [(str(i), [float(v) for v in a], [float(v) for v in b])
            for i, (a, b) in enumerate(zip(y, p))]
    df = spark.createDataFrame(rows, "id string, y array<double>, prob array<double>")
    return df.repartition(parts).withColumn(
        "logit", F.transform("prob", lambda x: F.log(x / (1 - x))))


def random_case(n=300, seed=0, digits=2):
    rng = np.random.default_rng(seed)
    y = (rng.random((n, 4)) < [0.5, 0.1, 0.0, 0.3]).astype(float)
    y[:, 3] = 1.0  # a class every paper has; class c has no support
    p = np.clip(np.round(rng.random((n, 4)) * 0.7 + 0.25 * y, digits), 0.01, 0.98)
    p[:, 1] *= 0.4  # class b is never predicted at one half
    return y, p


def prf(y, hit):
    tp, fp, fn = (y * hit).sum(0), ((1 - y) * hit).sum(0), (y * (1 - hit)).sum(0)

    def div(a, b):
        return np.divide(a, b, out=np.zeros_like(a, dtype=float), where=b != 0)

    return div(tp, tp + fp), div(tp, tp + fn), div(2 * tp, 2 * tp + fp + fn), tp, fp, fn


def test_report_against_numpy(spark):
    y, p = random_case()
    hit = (p > 0.5).astype(float)
    precision, recall, f1, tp, fp, fn = prf(y, hit)
    counts = M.confusion(frame(spark, y, p), 0.5, NAMES)
    got = M.report(counts).first().asDict()
    support = y.sum(0)
    assert got["f1"] == pytest.approx(f1.mean())
    assert got["precision"] == pytest.approx(precision.mean())
    assert got["recall"] == pytest.approx(recall.mean())
    assert got["f1_weighted"] == pytest.approx((f1 * support).sum() / support.sum())
    assert got["hit_rate"] == pytest.approx(((y * hit).sum(1) > 0).mean())
    micro = M.prf_micro(counts).first()
    assert micro["f1_micro"] == pytest.approx(2 * tp.sum() / (2 * tp.sum() + fp.sum() + fn.sum()))
    rows = M.prf_per_class(counts).orderBy("idx").collect()
    assert [r["label"] for r in rows] == NAMES
    assert [r["f1"] for r in rows] == pytest.approx(list(f1))
    assert (rows[1]["precision"], rows[2]["recall"]) == (0.0, 0.0)


def test_empty_predictions(spark):
    y = np.zeros((3, 2))
    got = M.report(M.confusion(frame(spark, y, y + 0.1), 0.5, NAMES[:2])).first().asDict()
    assert set(got.values()) == {0.0}


def test_published_macro_is_the_mean_of_class_f1(spark):
    # Two classes whose macro F1 differs from the F1 of the macro precision and recall.
    y = [[1, 0], [1, 0], [0, 1], [0, 1], [0, 1]]
    p = [[0.9, 0.9], [0.1, 0.9], [0.1, 0.1], [0.1, 0.9], [0.1, 0.1]]
    counts = M.confusion(frame(spark, y, p), 0.5, NAMES[:2])
    macro = M.prf_macro(counts).first()
    assert macro["f1"] == pytest.approx((2 / 3 + 1 / 3) / 2)


def test_compare_thresholds(spark):
    y, p = random_case(seed=4)
    per_class = {"a": 0.3, "b": 0.1, "c": 0.9}
    got = M.compare_thresholds(frame(spark, y, p), {"x": 0.35, "y": per_class}, NAMES)
    rows = {r["policy"]: r for r in got.collect()}
    for policy, t in {"x": [0.35] * 4, "y": [0.3, 0.1, 0.9, 0.5]}.items():
        assert rows[policy]["f1_macro"] == pytest.approx(
            prf(y, (p > np.array(t)).astype(float))[2].mean())


def brute_curve(y, p):
    for t in sorted(set(p)):
        sel = p >= t
        tp, n, pos = y[sel].sum(), sel.sum(), y.sum()
        precision, recall = tp / n, tp / pos if pos else 1.0
        yield t, precision, recall, 2 * precision * recall / (precision + recall + 1e-8)


@pytest.mark.parametrize("rows_per_bin", [1, 7, 50, 2_000_000])
def test_curve_against_brute_force(spark, rows_per_bin):
    y, p = random_case(seed=1, digits=3)
    p[:100, 0] = 0.5  # a third of the papers share one score
    rows = pr_curve(frame(spark, y, p), NAMES, rows_per_bin).collect()
    got = {(r["idx"], r["prob"]): (r["precision"], r["recall"], r["f1"]) for r in rows}
    want = {(c, t): rest for c in range(4) for t, *rest in brute_curve(y[:, c], p[:, c])}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_curve_with_every_score_near_zero(spark):
    """Saturated scores: the bins follow the scores, so they still split."""
    n = 400
    p = np.array([[1e-12 * (i + 1)] for i in range(n)])
    y = np.array([[float(i % 3 == 0)] for i in range(n)])
    rows = pr_curve(frame(spark, y, p), ["a"], rows_per_bin=10).collect()
    want = {t: f1 for t, _, _, f1 in brute_curve(y[:, 0], p[:, 0])}
    assert {r["prob"]: r["f1"] for r in rows} == pytest.approx(want)


def test_tune_against_brute_force(spark):
    y, p = random_case(seed=2)
    rows = tune(frame(spark, y, p), NAMES, 20).orderBy("idx").collect()
    for c, r in enumerate(rows):
        t, precision, recall, f1 = max(brute_curve(y[:, c], p[:, c]), key=lambda x: (x[3], -x[0]))
        assert r["threshold"] == pytest.approx(round(t, 4))
        assert r["f1"] == pytest.approx(f1, abs=6e-5)
    assert rows[2]["f1"] == 0.0 and rows[2]["threshold"] == pytest.approx(min(p[:, 2]))


def test_tune_edges(spark):
    one = tune(frame(spark, [[1.0]], [[0.7]]), ["a"]).first()
    assert (one["threshold"], one["f1"]) == (0.7, 1.0)
    tied = tune(frame(spark, [[1], [0], [1]], [[0.9], [0.5], [0.4]]), ["a"]).first()
    assert tied["threshold"] == 0.4
    empty = spark.createDataFrame([], "id string, y array<double>, prob array<double>")
    rows = best_thresholds(pr_curve(empty, ["a"]), ["a"]).collect()
    assert [(r["label"], r["threshold"], r["f1"]) for r in rows] == [("a", 0.5, 0.0)]


def test_tuned_score_beats_any_threshold_when_inclusive(spark):
    y, p = random_case(seed=3)
    df = frame(spark, y, p)
    tuned = tune(df, NAMES).select("label", "threshold").cache()
    best = M.prf_macro(M.confusion(df, tuned, NAMES, inclusive=True)).first()["f1"]
    strict = M.prf_macro(M.confusion(df, tuned, NAMES)).first()["f1"]
    assert strict <= best
    for t in (0.2, 0.35, 0.5, 0.8):
        assert M.prf_macro(M.confusion(df, t, NAMES, inclusive=True)).first()["f1"] <= best + 1e-9


def test_weights_and_loss(spark):
    y, p = random_case(seed=5)
    df = frame(spark, y, p)
    pos = y.sum(0)
    w = np.sqrt((len(y) - pos) / np.maximum(pos, 1))
    weights = pos_weight(df, NAMES)
    assert [r["pos_weight"] for r in weights.orderBy("idx").collect()] == pytest.approx(list(w))
    s = pos_weight_summary(weights).first()
    assert tuple(s) == pytest.approx((w.min(), w.max(), w.mean()))
    x = np.log(p / (1 - p))
    loss = (w * y * np.log1p(np.exp(-x)) + (1 - y) * np.log1p(np.exp(x))).mean()
    assert M.weighted_bce(df, pos_weight_vector(weights)).first()[0] == pytest.approx(loss)


def test_loss_of_extreme_logits_is_finite(spark):
    df = spark.createDataFrame([([1.0, 0.0], [-1000.0, 1000.0])],
                               "y array<double>, logit array<double>")
    assert M.weighted_bce(df, F.array(F.lit(2.0), F.lit(1.0))).first()[0] == 1500.0


def test_tag_metrics_ignore_rows_without_truth(spark):
    df = spark.createDataFrame(
        [(["a", "b"], ["a"]), ([], ["c"]), (None, ["a"]), (["zz"], ["zz", "b"])],
        "true_tags array<string>, predicted_tags array<string>")
    got = M.tag_metrics(df, NAMES).first().asDict()
    # tp: a. fp: c, b. fn: b. The unknown name counts only as a hit.
    assert got["papers"] == 3
    assert got["precision_micro"] == pytest.approx(1 / 3)
    assert got["recall_micro"] == pytest.approx(1 / 2)
    assert got["hit_rate"] == pytest.approx(2 / 3)


def test_tag_sets(column):
    rows = [(["a", "b"], ["b", "c"])]
    schema = "p array<string>, t array<string>"
    wrong, missed = M.tag_errors(F.col("p"), F.col("t"))
    assert column(rows, schema, M.tag_intersection(F.col("p"), F.col("t"))) == [["b"]]
    assert column(rows, schema, wrong) == [["a"]] and column(rows, schema, missed) == [["c"]]

