import json

import pytest
from pyspark.sql import functions as F

from labelmill.functions.scoring import predict, sigmoid, threshold_vector
from labelmill.functions.taxonomy import LABELS
from labelmill.plans.evaluation import resolve_thresholds
from labelmill.plans.tagging import add_tags
from labelmill.registry import views as V
from labelmill.sources.readers import read_thresholds
from labelmill.sources.writers import write_thresholds

NAMES = ["a", "b", "c"]


def test_sigmoid(column):
    got = column([(0.0,), (800.0,), (-800.0,)], "x double", sigmoid(F.col("x")))
    assert got == [0.5, 1.0, 0.0]


def test_threshold_boundary(column):
    rows = [([0.3, 0.5, 0.7],)]
    strict = predict(F.col("p"), threshold_vector(0.5, NAMES))
    loose = predict(F.col("p"), threshold_vector(0.5, NAMES), inclusive=True)
    assert column(rows, "p array<double>", strict) == [[False, False, True]]
    assert column(rows, "p array<double>", loose) == [[False, True, True]]


def vector(spark, *args, **kw):
    return spark.range(1).select(threshold_vector(*args, **kw)).first()[0]


def test_threshold_sources(spark):
    frame = spark.createDataFrame([("b", 0.2), ("extra", 0.9)], "label string, threshold double")
    assert vector(spark, None, NAMES) == [0.5] * 3
    assert vector(spark, {"a": 0.1}, NAMES) == [0.1, 0.5, 0.5]
    assert vector(spark, frame, NAMES) == [0.5, 0.2, 0.5]
    assert vector(spark, frame, NAMES, default=0.35) == [0.35, 0.2, 0.35]
    with pytest.raises(KeyError):
        vector(spark, {"a": 0.1}, NAMES, on_missing="error")
    with pytest.raises(Exception, match="no threshold"):
        vector(spark, frame, NAMES, on_missing="error")


def test_threshold_file(spark, tmp_path):
    path = tmp_path / "thresholds.json"
    path.write_text(json.dumps({"b": 0.25, "extra": 1}, indent=2))
    rows = read_thresholds(spark, str(path), NAMES).orderBy("idx").collect()
    assert [tuple(r) for r in rows] == [(0, "a", 0.5), (1, "b", 0.25), (2, "c", 0.5)]
    with pytest.raises(Exception, match="no threshold for"):
        read_thresholds(spark, str(path), NAMES, on_missing="error").collect()
    missing = read_thresholds(spark, str(tmp_path / "none.json"), NAMES, default=0.35)
    assert {r["threshold"] for r in missing.collect()} == {0.35}


def test_threshold_resolution_order(spark, tmp_path):
    model = str(tmp_path / "model")
    assert resolve_thresholds(spark, model, scalar=0.4, labels=NAMES) == 0.4
    frame = spark.createDataFrame([(x, 0.3) for x in NAMES], "label string, threshold double")
    write_thresholds(frame, f"{model}/thresholds")
    auto = resolve_thresholds(spark, model, labels=NAMES)
    assert {r["threshold"] for r in auto.collect()} == {0.3}
    other = str(tmp_path / "explicit")
    write_thresholds(frame.withColumn("threshold", F.lit(0.9)), other)
    explicit = resolve_thresholds(spark, model, other, labels=NAMES)
    assert {r["threshold"] for r in explicit.collect()} == {0.9}


def test_tags_and_probabilities(spark):
    df = spark.createDataFrame([("1", [0.9, 0.1, 0.61239]), ("2", [0.0, 0.0, 0.0])],
                               "id string, prob array<double>")
    rows = add_tags(df, 0.5, NAMES).orderBy("id").collect()
    assert rows[0]["predicted_tags"] == ["a", "c"]
    assert rows[0]["tag_probabilities"] == {"a": 0.9, "c": 0.6124}
    assert rows[1]["predicted_tags"] == [] and rows[1]["tag_probabilities"] == {}


def test_labels_of_a_made_up_score_are_worked_out_once(spark, tmp_path):
    """Inside a lambda every class would look the codes up again."""
    spark.sql("SELECT id AS o_orderkey, 'HIGH' AS o_orderpriority, 'F' AS o_orderstatus, "
              "timestamp '2020-01-01' AS o_orderdate FROM range(5)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT id % 4 AS l_orderkey, id * 31 AS l_partkey FROM range(20)").write.parquet(f"{tmp_path}/lineitem.parquet")
    known = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        rows = V.scored(spark, str(tmp_path))
        plan = rows.where("exists(prob, x -> x > 0.2)").select("id")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", known)
    assert 1 <= plan.count("element_at(") <= 2
    for r in rows.collect():
        assert r["y"] == [float(x in r["labels"]) for x in LABELS]
