from pyspark.sql import functions as F

from labelmill.functions.taxonomy import (
    CODE_TO_LABEL, LABELS, binarize_pivot, code_dim, codes_to_labels, label_dim, label_name,
    multihot, multihot_to_labels,
)
from labelmill.operators.profiling import join_codes, unmapped_codes


def test_label_dimension():
    assert len(LABELS) == 25 and len(CODE_TO_LABEL) == 173
    assert LABELS == sorted(LABELS)
    assert LABELS[2] == "CS Theory and Algorithms" and LABELS[10] == "Machine Learning"


def test_dims(spark):
    assert code_dim(spark).count() == 173
    assert [tuple(r) for r in label_dim(spark, ["a", "b"]).orderBy("idx").collect()] == [
        (0, "a"), (1, "b")]


def test_codes_to_labels(column):
    got = column(
        [(["cs.LG", "stat.ML"],), (["cs.OH"],), ([],), (["hep-th", "", "cs.CV", "x"],), (None,)],
        "c array<string>", codes_to_labels(F.col("c")))
    assert got == [["Machine Learning"], [], [], ["Computer Vision", "High Energy Physics"], None]


def test_codes_to_labels_with_another_mapping(column):
    got = column([(["p", "q", "r"],)], "c array<string>",
                 codes_to_labels(F.col("c"), {"p": "P", "q": "Q"}))
    assert got == [["P", "Q"]]


def test_multihot_round_trip(column):
    rows = [(["Robotics", "Astrophysics"],), ([],), (["no such label", "Robotics"],)]
    y = column(rows, "l array<string>", multihot(F.col("l")))
    assert [len(v) for v in y] == [25, 25, 25]
    assert [[LABELS[i] for i, x in enumerate(v) if x == 1.0] for v in y] == [
        ["Astrophysics", "Robotics"], [], ["Robotics"]]
    back = column(rows, "l array<string>", multihot_to_labels(multihot(F.col("l"))))
    assert back == [["Astrophysics", "Robotics"], [], ["Robotics"]]


def test_decode_is_strict(column):
    got = column([([0.5, 1.0, 2.0],)], "y array<double>",
                 multihot_to_labels(F.col("y"), ["a", "b", "c"]))
    assert got == [["b"]]


def test_label_name_falls_back(column):
    got = column([(0,), (24,), (25,)], "i int", label_name(F.col("i")))
    assert got == [LABELS[0], LABELS[24], "LABEL_25"]


def test_binarize(spark):
    df = spark.createDataFrame([("1", ["b", "z"]), ("2", [])], "id string, l array<string>")
    rows = binarize_pivot(df, "id", "l", ["a", "b"]).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", 0, 1), ("2", 0, 0)]


def test_join_forms(spark):
    df = spark.createDataFrame(
        [("1", ["cs.LG", "stat.ML", "cs.OH"]), ("2", ["", "cs.OH"])],
        "id string, categories array<string>")
    assert [tuple(r) for r in join_codes(df, code_dim(spark)).collect()] == [
        ("1", "Machine Learning")]
    assert [tuple(r) for r in unmapped_codes(df, code_dim(spark)).collect()] == [("cs.OH", 2)]
