"""Datasets on disk: layout, pruning, pushed filters, commit and abort."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelmill.sources import arrow_dataset as A
from labelmill.sources.arrow_dataset import read_dataset, write_dataset


def rows(spark, n=200):
    base = spark.range(n).repartition(4)
    return base.select(
        F.col("id"), F.concat(F.lit("té"), F.col("id")).alias("title"),
        F.when(F.col("id") % 5 != 0, F.array(F.col("id").cast("double"))).alias("y"),
        F.when(F.col("id") % 3 != 0, (F.col("id") % 7).cast("int")).alias("n"),
        F.struct(F.col("id").alias("a"), F.lit(None).cast("string").alias("b")).alias("s"),
        F.map_from_arrays(F.array(F.lit("k")), F.array("id")).alias("m"),
        F.when(F.col("id") < 150, "train").when(F.col("id") < 180, "val").otherwise("test").alias("split"),
    )


def plain(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: r["id"])


@pytest.fixture()
def saved(spark, tmp_path):
    path = str(tmp_path / "data")
    write_dataset(rows(spark), path)
    return path


def test_round_trip(spark, saved):
    back = read_dataset(spark, saved)
    assert plain(back.select(*rows(spark).columns)) == plain(rows(spark))
    assert back.dtypes == [d for d in rows(spark).dtypes if d[0] != "split"] + [("split", "string")]


def test_layout(saved, tmp_path):
    assert json.loads((tmp_path / "data" / "dataset_dict.json").read_text()) == {"splits": ["test", "train", "val"]}
    for split, n in (("train", 150), ("val", 30), ("test", 20)):
        folder = tmp_path / "data" / split
        listed = [f["filename"] for f in json.loads((folder / "state.json").read_text())["_data_files"]]
        assert listed == [f"data-{i:05d}-of-{len(listed):05d}.arrow" for i in range(len(listed))]
        assert sorted(listed) == sorted(p.name for p in folder.glob("*.arrow"))
        found = 0
        for name in listed:  # any reader of the format can open them
            with pa.memory_map(str(folder / name)) as f:
                found += pa.ipc.open_stream(f).read_all().num_rows
        assert found == n == json.loads((folder / "dataset_info.json").read_text())["num_rows"]
    assert [p.name for p in tmp_path.iterdir()] == ["data"]


def test_a_partition_per_shard_and_pushed_filters(spark, saved, tmp_path):
    every = read_dataset(spark, saved)
    files = {s: len(list((tmp_path / "data" / s).glob("*.arrow"))) for s in ("train", "val", "test")}
    assert every.rdd.getNumPartitions() == sum(files.values())
    val = every.where("split = 'val'")
    assert val.rdd.getNumPartitions() == files["val"]
    assert val.count() == 30
    plan = val._jdf.queryExecution().explainString(val._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(split,val)" in plan.replace(", ", ",")  # pushed
    assert "Filter (" not in plan and "(2) Filter" not in plan  # and not asked again
    both = every.where("split IN ('val', 'test') AND n >= 3 AND title > 'té17'")
    want = [r for r in plain(rows(spark)) if r["split"] != "train" and (r["n"] or 0) >= 3 and r["title"] > "té17"]
    assert [r["id"] for r in plain(both)] == [r["id"] for r in want] and want
    assert every.where("split = 'none'").count() == 0
    assert every.where("n IS NULL").count() == sum(r["n"] is None for r in plain(rows(spark)))
    assert every.where("y[0] > 10 OR n = 1").count() == sum((r["y"] or [0])[0] > 10 or r["n"] == 1 for r in plain(rows(spark)))


def test_only_the_columns_asked_for_are_read(spark, saved, monkeypatch):
    back = read_dataset(spark, saved, ["title", "split"])
    assert back.columns == ["title", "split"] and back.where("split = 'val'").count() == 30
    asked, real = [], pa.ipc.open_stream

    def spy(source, options=None):
        if options is not None:
            asked.append(tuple(options.included_fields))
        return real(source, options=options)

    monkeypatch.setattr(pa.ipc, "open_stream", spy)
    reader = A.ArrowShards({"path": saved}).reader(back.schema)
    for shard in reader.partitions():
        for batch in reader.read(shard):
            assert batch.schema.names == ["title", "split"]
    assert set(asked) == {(1,)}
    with pytest.raises(Exception, match="has no column"):
        spark.read.format(A.FORMAT).schema("other string").load(saved).collect()


def test_a_failing_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "data")
    write_dataset(rows(spark, 10), path)
    broken = rows(spark).withColumn("title", F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="lost"):
        write_dataset(broken, path, "overwrite")
    assert read_dataset(spark, path).count() == 10  # what was there stays
    with pytest.raises(Exception, match="cannot name a split"):
        write_dataset(rows(spark).withColumn("split", F.lit("a/b")), str(tmp_path / "other"))
    with pytest.raises(Exception, match="FileExists"):
        write_dataset(rows(spark, 10), path)
    write_dataset(rows(spark, 20), path, "overwrite")
    assert read_dataset(spark, path).count() == 20
    assert [p.name for p in tmp_path.iterdir()] == ["data"]


def test_without_splits_and_empty(spark, tmp_path):
    one, none, empty = (str(tmp_path / n) for n in ("one", "none", "empty"))
    write_dataset(rows(spark, 30).drop("split"), one)
    assert plain(read_dataset(spark, one)) == plain(rows(spark, 30).drop("split"))
    write_dataset(rows(spark, 0).drop("split"), none)
    assert read_dataset(spark, none).count() == 0
    write_dataset(rows(spark, 0), empty)
    back = read_dataset(spark, empty)
    assert back.count() == 0 and back.dtypes == read_dataset(spark, empty).dtypes and "split" in back.columns
    with pytest.raises(Exception, match="holds no dataset"):
        read_dataset(spark, str(tmp_path / "nowhere")).count()
