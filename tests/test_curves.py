import pytest
from pyspark.sql import functions as F

from labelmill.operators import curves as C


def ema(values, alpha=0.05):
    out = [values[0]]
    for v in values[1:]:
        out.append(alpha * v + (1 - alpha) * out[-1])
    return out


@pytest.mark.parametrize("chunk", [4, 7, 64, 512])
def test_ema_against_the_loop(spark, chunk):
    """One long series, short ones, gaps, and chunks small enough for several levels."""
    series = {"long": [((i * 37) % 1000) / 10 for i in range(1500)], "one": [4.0],
              "few": [1.0, 5.0, 2.0]}
    steps = {"long": [3 * i + (i % 2) for i in range(1500)], "one": [900], "few": [10, 600, 4000]}
    rows = [(k, s, v) for k in series for s, v in zip(steps[k], series[k])]
    df = spark.createDataFrame(rows, "run string, step bigint, loss double").repartition(5)
    got = C.ema_series(df, ["run"], "step", "loss", chunk=chunk).collect()
    assert len(got) == len(rows)
    for k in series:
        mine = [r["ema"] for r in sorted((r for r in got if r["run"] == k), key=lambda r: r["step"])]
        assert mine == pytest.approx(ema(series[k]))


def test_ema_of_nothing(spark):
    df = spark.createDataFrame([], "run string, step bigint, loss double")
    assert C.ema_series(df, ["run"], "step", "loss").collect() == []


SCHEMA = "run string, step bigint, loss double"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_ema_of_short_series_far_apart_is_one_exchange(spark):
    """Steps far apart need no chunks: the rows meet once and no join follows."""
    rows = [(f"r{i % 40}", 1000 * i, float(i % 7)) for i in range(800)]
    got = C.ema_series(spark.createDataFrame(rows, SCHEMA).repartition(3), ["run"], "step", "loss", chunk=64)
    assert exchanges(got) == 1
    for k in {r[0] for r in rows}:
        mine = [r["ema"] for r in sorted((r for r in got.collect() if r["run"] == k), key=lambda r: r["step"])]
        assert mine == pytest.approx(ema([v for run, _, v in rows if run == k]))


def test_ema_of_a_long_series_among_short_ones_with_odd_rows(spark):
    """A hot series is chunked, the others are not; null keys go where positions span more than a chunk."""
    hot = [("hot", 3 * i, float(i % 11)) for i in range(300)]
    rows = hot + [(f"r{i}", 500 * i, float(i)) for i in range(60)] + [(f"r{i}", 7, 1.0) for i in range(1, 60)]
    odd = [(None, 5, 1.0), (None, 900, 2.0), ("r3", None, 4.0)]
    got = C.ema_series(spark.createDataFrame(rows + odd, SCHEMA).repartition(4), ["run"], "step", "loss", chunk=16).collect()
    assert sorted((r["run"], r["step"], r["loss"]) for r in got) == sorted(rows)
    for k in {r[0] for r in rows}:
        mine = [r["ema"] for r in sorted((r for r in got if r["run"] == k), key=lambda r: r["step"])]
        first = [4.0] if k == "r3" else []  # the step without a position is not returned but comes first
        assert mine == pytest.approx(ema(first + [v for run, _, v in sorted(rows) if run == k])[len(first):])
    near = C.ema_series(spark.createDataFrame([(None, 5, 1.0), (None, 9, 2.0)], SCHEMA), ["run"], "step", "loss").collect()
    assert len(near) == 2


def test_ema_of_rows_that_come_twice(spark):
    """Equal steps of a series are all kept, folded in the order of their values."""
    rows = [("a", 10, 2.0), ("a", 10, 2.0), ("a", 90_000, 4.0), ("a", 90_000, 3.0)]
    got = C.ema_series(spark.createDataFrame(rows, SCHEMA), ["run"], "step", "loss").orderBy("step", "loss").collect()
    assert [r["ema"] for r in got] == pytest.approx(ema([2.0, 2.0, 3.0, 4.0]))


def test_ema_alpha(spark):
    df = spark.createDataFrame([("r", 1, 1.0), ("r", 2, 3.0)], "run string, step bigint, loss double")
    rows = C.ema_series(df, ["run"], "step", "loss", alpha=0.5).orderBy("step").collect()
    assert [r["ema"] for r in rows] == [1.0, 2.0]


@pytest.fixture()
def log(spark):
    columns = ("step bigint, loss double, learning_rate double, eval_loss double, eval_f1 double, "
               "eval_f1_weighted double, eval_precision double, eval_recall double")
    rows = [("r", 1, 0.9, 1e-5, None, None, None, None, None),
            ("r", 2, 0.7, 2e-5, None, None, None, None, None),
            ("r", 2, None, None, 0.8, 0.5, 0.6, 0.4, 0.7),
            ("r", 4, None, None, 0.7, 0.9, 0.6, 0.4, 0.7),
            ("r", 6, None, None, 0.9, 0.9, 0.6, 0.4, 0.7)]
    return spark.createDataFrame(rows, f"run string, {columns}")


def test_log_split_and_best(log):
    assert C.train_rows(log).count() == 2 and C.eval_rows(log).count() == 3
    assert tuple(C.best_checkpoint(log).first()) == ("r", 4, 0.9)


def test_tidy_curves(log):
    rows = C.training_curves(log).collect()
    by = {}
    for r in rows:
        by.setdefault(r["series"], []).append((r["step"], r["value"]))
    assert sorted(by["train_loss"]) == [(1, 0.9), (2, 0.7)]
    assert sorted(by["train_loss_ema"]) == [(1, 0.9), (2, pytest.approx(0.05 * 0.7 + 0.95 * 0.9))]
    assert by["best_f1"] == [(4, 0.9)]
    assert set(by) == {"train_loss", "train_loss_ema", "learning_rate", "eval_loss", "eval_f1",
                       "eval_f1_weighted", "eval_precision", "eval_recall", "best_f1"}
    assert log.where(F.col("eval_loss").isNotNull()).count() == len(by["eval_loss"])
