import json

import pytest
from pyspark.sql import functions as F

from labelmill.functions.records import (
    broadcast_abstract, default_fields, flatten_struct, parse_request_batch, percent_text,
    resolve_id, tag_cards, validate_records,
)
from labelmill.plans.tagging import as_records
from labelmill.sources import files, landing, readers, writers


def test_resolve_id(spark):
    df = spark.createDataFrame(
        [("1", "2", "3"), ("", "2", "3"), (None, "", "3"), (None, None, "")],
        "id string, arxiv_id string, paper_id string")
    assert [r[0] for r in df.select(resolve_id(df)).collect()] == ["1", "2", "3", None]
    one = df.select("paper_id")
    assert [r[0] for r in one.select(resolve_id(one)).collect()] == ["3", "3", "3", None]


def test_defaults_and_one_abstract(spark):
    df = spark.createDataFrame([("t",), (None,)], "title string")
    assert [tuple(r) for r in default_fields(df).collect()] == [("t", ""), ("", "")]
    assert [r["abstract"] for r in broadcast_abstract(df, "all").collect()] == ["all", "all"]


def test_validation(spark):
    df = spark.createDataFrame([("a",), (None,), (" \t ",), ("",)], "title string")
    reasons = [r["reject_reason"] for r in validate_records(df).collect()]
    assert reasons == [None, "missing title", "blank title", "blank title"]


def test_request_bodies(spark):
    bodies = [
        json.dumps([{"title": "a"}, {"title": "b", "abstract": "x"}, {"abstract": "y"}]),
        "[]", '{"title": "a"}', "not json", "[", None,
    ]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "n int, body string")
    rows = parse_request_batch(df).orderBy("n", "title").collect()
    got = {}
    for r in rows:
        got.setdefault(r["n"], []).append((r["title"], r["abstract"], r["reject_reason"]))
    assert got[0] == [(None, "y", "missing title"), ("a", "", None), ("b", "x", None)]
    assert got[1] == [(None, "", "empty batch")]
    for n in (2, 3, 4, 5):
        assert got[n] == [(None, "", "not a JSON array")], n


def test_flatten(spark):
    df = spark.sql("SELECT 1 AS a, named_struct('x', 2, 'y', named_struct('z', 3)) AS b")
    flat = flatten_struct(df)
    assert flat.columns == ["a", "b.x", "b.y.z"] and tuple(flat.first()) == (1, 2, 3)
    assert flatten_struct(df, "_").columns == ["a", "b_x", "b_y_z"]


def test_percent_text(column):
    got = column([(0.1225,), (0.1235,), (0.5,), (1.0,), (0.0004,)], "p double",
                 percent_text(F.col("p")))
    assert got == ["12.3%", "12.3%", "50.0%", "100.0%", "0.0%"]


def test_cards(spark):
    df = spark.createDataFrame(
        [("t", ["a", "b", "c"], {"a": 0.5, "b": 0.9, "c": 0.5}), ("u", [], {}), ("v", ["a"], {"a": 1.0})],
        "title string, predicted_tags array<string>, tag_probabilities map<string,double>")
    rows = {r["title"]: r for r in tag_cards(df).collect()}
    assert rows["t"]["bars"] == ["b 90.0%", "a 50.0%", "c 50.0%"]
    assert (rows["t"]["tag_count_text"], rows["u"]["tag_count_text"], rows["v"]["tag_count_text"]) \
        == ("3 tags", "0 tags", "1 tag")
    assert rows["u"]["no_tags"] and not rows["t"]["no_tags"]


def test_records_scan(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"id": "1", "title": "a"}\n\n  \n{"paper_id": "2", "labels": ["x"]}\n')
    rows = readers.read_records(spark, str(good)).collect()
    assert [(r["id"], r["paper_id"], r["labels"]) for r in rows] == [
        ("1", None, None), (None, "2", ["x"])]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id": "1"}\n{broken\n')
    with pytest.raises(Exception):
        readers.read_records(spark, str(bad)).collect()
    kept = readers.read_records(spark, str(bad), keep_bad=True).cache().collect()
    assert [r["_corrupt_record"] for r in kept] == [None, "{broken"]


def test_predictions_keep_nulls(spark, tmp_path):
    df = spark.createDataFrame([("1", "t", None, ["a"], {"a": 0.5}, "extra")],
                               "id string, title string, true_tags array<string>, "
                               "predicted_tags array<string>, "
                               "tag_probabilities map<string,double>, more string")
    out = str(tmp_path / "p")
    writers.write_predictions(df, out)
    line = json.loads(spark.read.text(out).first()[0])
    assert line == {"id": "1", "title": "t", "true_tags": None, "predicted_tags": ["a"],
                    "tag_probabilities": {"a": 0.5}}
    writers.write_predictions(df, out, keep_input=True)
    assert json.loads(spark.read.text(out).first()[0])["more"] == "extra"


def test_ingest_once(spark, tmp_path):
    path = str(tmp_path / "landing")
    first = spark.createDataFrame([(1,)], "a int")
    assert landing.ingest_once(first, path).collect() == [(1,)]
    assert landing.ingest_once(spark.createDataFrame([(2,)], "a int"), path).collect() == [(1,)]


def test_a_dead_write_is_no_landing(spark, tmp_path):
    path = str(tmp_path / "landing")
    rows = spark.range(100).repartition(4)
    rows.where("id < 3").write.parquet(path)  # no manifest
    assert landing.manifest(spark, path) is None
    assert landing.ingest_once(rows, path).count() == 100
    assert landing.manifest(spark, path)["rows"] == 100
    part = next((tmp_path / "landing").glob("part-*"))
    part.unlink()  # a file is gone: whole again from the source
    assert landing.manifest(spark, path) is None
    assert landing.ingest_once(rows, path).count() == 100
    assert landing.ingest_once(spark.range(5), path).count() == 100
    assert landing.ingest_once(spark.range(0), str(tmp_path / "none")).count() == 0


def test_of_two_landings_one_wins(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "landing")
    first = landing._sizes

    def late(session, folder):  # the other lands while this one is about to commit
        monkeypatch.setattr(landing, "_sizes", first)
        landing.ingest_once(spark.range(7), path)
        return first(session, folder)

    monkeypatch.setattr(landing, "_sizes", late)
    assert landing.ingest_once(spark.range(100), path).count() == 7
    assert [p.name for p in tmp_path.iterdir()] == ["landing"]


def test_staging_of_dead_writes_is_swept(spark, tmp_path):
    path = str(tmp_path / "landing")
    spark.range(3).write.parquet(str(tmp_path / ".staging-landing-dead"))
    landing.ingest_once(spark.range(9), path)
    assert landing.sweep(spark, path) == []
    assert len(landing.sweep(spark, path, older_than_hours=-1)) == 1
    assert landing.ingest_once(spark.range(1), path).count() == 9


def test_documents_are_single_files(spark, tmp_path):
    frame = spark.createDataFrame([("b", 0.25), ("a", 0.5)], "label string, threshold double")
    path = tmp_path / "out" / "thresholds"
    writers.write_thresholds(frame, str(path))
    assert json.loads(path.read_text()) == {"a": 0.5, "b": 0.25}
    writers.write_thresholds(frame.where("label = 'a'"), str(path))
    assert json.loads(path.read_text()) == {"a": 0.5}
    (tmp_path / "report").mkdir()
    (tmp_path / "report" / "part-0").write_text("old")
    writers.write_report(spark.range(1).selectExpr("1 AS f1", "CAST(NULL AS INT) AS loss"), str(tmp_path / "report"))
    assert json.loads((tmp_path / "report").read_text()) == {"f1": 1, "loss": None}
    writers.write_label_counts(spark.createDataFrame([("x", 1), ("y", 5)], "label string, count long"), str(tmp_path / "counts.csv"))
    assert (tmp_path / "counts.csv").read_text().split() == ["label,count", "y,5", "x,1"]
    with pytest.raises(FileExistsError):
        writers.write_report(frame, str(tmp_path / "report"), mode="error")
    writers.write_report(frame, str(tmp_path / "report"), mode="ignore")
    writers.write_thresholds(frame.limit(0), str(tmp_path / "none"))
    assert json.loads((tmp_path / "none").read_text()) == {}
    left = [p.name for p in [*tmp_path.iterdir(), *path.parent.iterdir()] if p.suffix != ".crc"]
    assert sorted(left) == ["counts.csv", "none", "out", "report", "thresholds"]
    assert not files.rename_new(spark, str(path), str(tmp_path / "report"))


def test_log_scan(spark, tmp_path):
    state = {"run": "r", "best_global_step": 2, "best_metric": 0.5, "log_history": [
        {"step": 1, "loss": 0.9, "learning_rate": 1e-5}, {"step": 2, "eval_loss": 0.8, "eval_f1": 0.5}]}
    path = tmp_path / "state.json"
    path.write_text(json.dumps(state, indent=2))
    rows = readers.read_train_log(spark, str(path), multiline=True).orderBy("step").collect()
    assert [(r["run"], r["step"], r["loss"], r["eval_loss"]) for r in rows] == [
        ("r", 1, 0.9, None), ("r", 2, None, 0.8)]


def test_multihot_true_tags_are_decoded(spark):
    y = [0.0] * 25
    y[1] = 1.0
    df = spark.createDataFrame([("t", y), ("u", None)], "title string, labels array<double>")
    rows = as_records(df).orderBy("title").collect()
    assert [r["true_tags"] for r in rows] == [["Astrophysics"], None]
    assert all(r["id"] is None for r in rows)


def test_split_folders(spark, tmp_path):
    df = spark.createDataFrame([(str(i), "train" if i % 5 else "val") for i in range(50)],
                               "id string, split string")
    for files in (None, 3):
        path = str(tmp_path / f"s{files}")
        writers.write_splits(df, path, files_per_split=files)
        back = spark.read.schema("id string, split string").parquet(path)
        assert readers.select_split(back, "val").count() == 10
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert readers.select_split(df.drop("split"), "val").count() == 50


def test_compacted_splits_are_written_without_a_sort(spark, tmp_path):
    before = spark.conf.get(writers.OPEN_FILES)
    names = [f"s{i % 20}" for i in range(200)]  # more than are open at once: all are written
    for splits in (["train", "val", None] * 60, names):
        df = spark.createDataFrame([(str(i), x) for i, x in enumerate(splits)], "id string, split string")
        path = str(tmp_path / f"s{len(splits)}")
        writers.write_splits(df, path, files_per_split=2)
        assert spark.conf.get(writers.OPEN_FILES) == before
        back = spark.read.schema("id string, split string").parquet(path)
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
        runs = spark._jsparkSession.sharedState().statusStore().executionsList()
        plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
        assert "Sort" not in next(p for p in reversed(plans) if "InsertIntoHadoopFs" in p and path in p)


def test_broken_lines_are_never_lost(spark, tmp_path):
    import pytest

    from labelmill.sources import readers

    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    snapshot = put("papers.json", '{"id": "1", "title": "a"}\n{broken\n{"id": "2"}\n')
    log = put("log.json", '{"run": "a", "log_history": [], "best_global_step": 7, "best_metric": 0.5}\n{broken\n')
    counts = put("counts.csv", "label,count\na,3\nb,many\n")
    for read in (readers.read_papers_jsonl, readers.read_records):
        with pytest.raises(Exception):
            read(spark, snapshot).collect()
    with pytest.raises(Exception):
        readers.read_train_log(spark, log).collect()
    with pytest.raises(Exception):
        readers.read_label_counts(spark, counts).collect()
    good, bad = readers.split_bad(readers.read_papers_jsonl(spark, snapshot, keep_bad=True))
    assert sorted(r["id"] for r in good.collect()) == ["1", "2"]
    assert [r["raw_line"] for r in bad.collect()] == ["{broken"]
    whole = put("whole.json", '{"run": "a", "log_history": [], "best_global_step": 7, "best_metric": 0.5}\n')
    assert tuple(readers.read_recorded_best(spark, whole).first()) == ("a", 7, 0.5)
    for text in ('{"A": 0.9, "B": oops}', "nonsense", '{"A": null}', "[1]"):
        with pytest.raises(Exception):
            readers.read_thresholds(spark, put("t.json", text), ["A", "B"]).collect()
    fine = readers.read_thresholds(spark, put("t.json", '{"A": 0.9, "X": 1}'), ["A", "B"]).orderBy("idx").collect()
    assert [r["threshold"] for r in fine] == [0.9, 0.5]
