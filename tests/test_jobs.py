import json
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from labelmill import schemas as S
from labelmill.operators.linear_model import score_linear, train_linear
from labelmill.operators.profiling import (
    align_distributions, coverage_curve, js_divergence, label_distribution, top_bottom,
)
from labelmill.plans import evaluation, prep, tagging
from labelmill.registry import views as V
from labelmill.session import run_folder, scratch_path, scratch_root, stored
from labelmill.sources import readers
from labelmill.streaming import tagging as stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ready(spark):
    papers = stored(V.papers(spark, SF), "papers")
    return papers, train_linear(papers.where("split = 'train'")).stored()


def test_prep_job_stages(spark, tmp_path):
    raw = V.papers_raw(spark, SF)
    out = str(tmp_path / "prep")
    stages = prep.prep_job(raw, out, vocab_size=500, max_length=64, exact=True)
    assert stages["base"].count() == raw.count()
    sizes = {r["split"]: r["count"] for r in stages["taxonomy"].groupBy("split").count().collect()}
    n = sum(sizes.values())
    held = -(-n // 5)
    assert sizes["train"] == n - held and sizes["test"] == -(-held // 2)
    assert stages["encoded"].count() == n
    assert stages["encoded"].agg(F.max(F.size("input_ids"))).first()[0] == 64
    index = json.loads(spark.read.text(f"{out}/label_to_index").first()[0])["label_to_index"]
    assert index["Astrophysics"] == 1 and len(index) == 25
    meta = json.loads(spark.read.text(f"{out}/encoding_meta").first()[0])
    assert meta["max_length"] == 64 and meta["encoded"].endswith("encoded")


def test_pruned_split_read(spark, tmp_path):
    path = str(tmp_path / "t")
    prep.write_splits(prep.taxonomy(V.papers_base(spark, SF)), path)
    rows = readers.select_split(readers.read_stage(spark, path, S.TAXONOMY), "val").select("id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "ReadSchema: struct<id:string>" in plan


def test_prep_is_one_narrow_stage(spark, tmp_path):
    """Scan to taxonomy runs without an exchange and without Python."""
    path = str(tmp_path / "raw")
    V.papers_raw(spark, SF).write.json(path)
    rows = prep.with_y(prep.taxonomy(prep.base(readers.read_papers_jsonl(spark, path))))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_scoring_moves_one_row_per_paper(spark, ready):
    papers, model = ready
    scored = score_linear(papers, model, key="id")
    scored.collect()
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "partial_sum" in plan and "Python" not in plan and plan.count("Generate") <= 2


def test_tune_then_evaluate(spark, ready, tmp_path):
    papers, _ = ready
    model = train_linear(papers.where("split = 'train'"), min_papers=5).stored()
    model_dir = str(tmp_path / "model")
    model.save(model_dir)
    before = evaluation.eval_job(papers, model, model_dir, scalar=0.5).first()
    tuned, compared = evaluation.tune_job(papers, model, f"{model_dir}/thresholds")
    scores = {r["policy"]: r["f1_macro"] for r in compared.collect()}
    assert scores["per_class"] >= scores["scalar"] * 0.9
    assert tuned.count() == 25
    after = evaluation.eval_job(papers, model, model_dir, str(tmp_path / "report")).first()
    written = json.loads(spark.read.text(str(tmp_path / "report")).first()[0])
    assert written["f1"] == pytest.approx(after["f1"])
    assert before["loss"] == pytest.approx(after["loss"])
    fixed = evaluation.evaluate(papers, model, 0.5).first()
    assert fixed["f1"] == pytest.approx(before["f1"])


def test_inference_job(spark, ready, tmp_path):
    _, model = ready
    records = V.records(spark, SF)
    out = str(tmp_path / "predictions")
    metrics, summary = tagging.inference_job(records, model, out)
    assert summary["processed"] == records.count() == spark.read.text(out).count()
    with_truth = records.where("labels IS NOT NULL").count()
    assert metrics.first()["papers"] == with_truth
    ids = records.where("id <> ''")
    by_id = tagging.inference_job(ids, model, str(tmp_path / "by-id"), key="id")[0].first()
    assert by_id == tagging.inference_job(ids, model, str(tmp_path / "by-key"))[0].first()
    _, limited = tagging.inference_job(records, model, str(tmp_path / "few"), limit=7)
    assert limited["processed"] == 7


def test_prediction_lines_with_all_input(spark, ready, tmp_path):
    _, model = ready
    records = V.records(spark, SF)
    out = str(tmp_path / "full")
    tagging.inference_job(records, model, out, keep_input=True)
    lines = [json.loads(r[0]) for r in spark.read.text(out).collect()]
    wanted = {*records.columns, "true_tags", "predicted_tags", "tag_probabilities"}
    assert all(set(x) == wanted for x in lines)
    assert sorted(x["abstract"] for x in lines) == sorted(r["abstract"] or "" for r in records.collect())


def test_tagging_one_row_equals_tagging_many(spark, ready):
    papers, model = ready
    whole = {r["id"]: r["predicted_tags"] for r in tagging.tag_papers(papers, model).collect()}
    some = papers.orderBy("id").limit(1)
    row = tagging.tag_papers(some, model).first()
    assert whole[row["id"]] == row["predicted_tags"]
    again = tagging.tag_papers(papers.repartition(11, F.rand(3)), model).collect()
    assert whole == {r["id"]: r["predicted_tags"] for r in again}


def feed(spark, records, model, batches):
    source, out, progress = (scratch_path(spark, x) for x in ("in", "out", "progress"))
    records.repartition(4, F.col("title")).write.json(source)
    rows = stream.read_record_stream(spark, source, files_per_batch=batches)
    stream.start_tagging(rows, model, out, progress).awaitTermination()
    return source, out, progress


def plain(df):
    rows = df.select("id", "title", "true_tags", "predicted_tags",
                     F.array_sort(F.map_entries("tag_probabilities")).alias("p"))
    return sorted(map(str, rows.collect()))


def test_stream_equals_batch_and_replays_cleanly(spark, ready):
    _, model = ready
    records = V.records(spark, SF)
    source, out, progress = feed(spark, records, model, 2)
    valid = records.where("title IS NOT NULL AND trim(title) <> ''")
    batch = tagging.tag_papers(tagging.as_records(valid), model)
    got = stream.read_tagged(spark, out)
    assert plain(got) == plain(batch)
    assert stream.read_rejects(spark, out).count() == records.count() - valid.count()
    # Another progress folder replays every batch onto the same output.
    rows = stream.read_record_stream(spark, source, files_per_batch=2)
    stream.start_tagging(rows, model, out, scratch_path(spark, "progress")).awaitTermination()
    assert plain(stream.read_tagged(spark, out)) == plain(batch)


@pytest.mark.parametrize("dies_at", ["write_tagged", "write_document"])
def test_a_batch_that_dies_is_seen_in_neither_output(spark, ready, tmp_path, monkeypatch, dies_at):
    _, model = ready
    out, progress = str(tmp_path / "out"), str(tmp_path / "cp")
    lines = [json.dumps({"id": str(i), "title": f"t{i}", "abstract": "x"}) for i in range(6)] + ['{"id": "7"}']
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(lines[:3]))

    def run():
        rows = stream.read_record_stream(spark, str(source))
        stream.start_tagging(rows, model, out, progress).awaitTermination()

    run()
    (source / "b.json").write_text("\n".join(lines[3:]))
    kept = getattr(stream, dies_at)

    def dies(*given, **named):
        raise OSError("executor and driver are gone")

    monkeypatch.setattr(stream, dies_at, dies)
    with pytest.raises(Exception, match="gone"):
        run()
    assert stream.committed(spark, out) == [0]
    assert sorted(r["id"] for r in stream.read_tagged(spark, out).collect()) == ["0", "1", "2"]
    assert stream.read_rejects(spark, out).count() == 0
    monkeypatch.setattr(stream, dies_at, kept)
    run()
    assert stream.committed(spark, out) == [0, 1]
    assert sorted(r["id"] for r in stream.read_tagged(spark, out).collect()) == [str(i) for i in range(6)]
    assert [r["id"] for r in stream.read_rejects(spark, out).collect()] == ["7"]


def test_a_committed_batch_is_not_written_again(spark, ready, tmp_path):
    _, model = ready
    out, progress = str(tmp_path / "out"), tmp_path / "cp"
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text(json.dumps({"id": "1", "title": "t", "abstract": "x"}))

    def run():
        stream.start_tagging(stream.read_record_stream(spark, str(source)), model, out, str(progress)).awaitTermination()
        return sorted(p.name for p in (tmp_path / "out" / "tagged" / "batch_id=0").iterdir())

    before = run()
    for name in ("0", ".0.crc"):  # the ledger has the batch, the checkpoint lost it
        (progress / "commits" / name).unlink(missing_ok=True)
    assert run() == before
    assert stream.read_tagged(spark, out).count() == 1


def test_micro_batches_leave_nothing_in_the_scratch_folder(spark, ready, tmp_path):
    _, model = ready
    root = Path(scratch_root(spark).removeprefix("file://"))
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text(json.dumps({"id": "1", "title": "t", "abstract": "x"}))
    rows = stream.read_record_stream(spark, str(source))
    before = set(root.iterdir())
    stream.start_tagging(rows, model, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert set(root.iterdir()) == before


def test_runs_in_threads_have_folders_of_their_own(spark):
    def job(i):
        with run_folder(spark, f"job{i}") as path:
            first = stored(spark.range(10 * (i + 1)), "first")
            time.sleep(0.5 * (2 - i))
            second = stored(first, "second")
            return path, second.count(), second.inputFiles()

    with ThreadPoolExecutor(2) as pool:
        found = list(pool.map(job, range(2)))
    assert [n for _, n, _ in found] == [10, 20]
    assert all(path in name for path, _, names in found for name in names)


def test_stream_rejects_malformed_lines(spark, ready, tmp_path):
    _, model = ready
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": "1", "title": "ok"}\n{broken\n{"id": "2"}\n')
    rows = stream.read_record_stream(spark, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream.start_tagging(rows, model, out, str(tmp_path / "cp")).awaitTermination()
    assert [r["id"] for r in stream.read_tagged(spark, out).collect()] == ["1"]
    rejects = stream.read_rejects(spark, out).collect()
    assert sorted((r["reject_reason"], r["raw_line"]) for r in rejects) == [
        ("malformed record", "{broken"), ("missing title", None)]


# ---- profile ----

def test_coverage_against_the_loop(spark):
    sets = [["a", "b"], ["b"], ["c"], [], ["a", "d", "b"], ["d"], ["b", "c"], None]
    df = spark.createDataFrame([(s,) for s in sets], "labels array<string>")
    counts = {}
    for s in sets:
        for x in s or []:
            counts[x] = counts.get(x, 0) + 1
    order = sorted(counts, key=lambda x: (-counts[x], x))
    want = [("", 0, 0.0)]
    for i, x in enumerate(order):
        n = sum(bool(set(s or []) & set(order[: i + 1])) for s in sets)
        want.append((x, n, n / len(sets) * 100))
    got = coverage_curve(df).orderBy("rank").collect()
    assert [(r["label"], r["covered"], r["coverage"]) for r in got] == want


def counts_of(spark, split, numbers):
    return [(split, f"l{i:02d}", n) for i, n in enumerate(numbers)]


def test_js_divergence(spark):
    rows = counts_of(spark, "a", [1, 1]) + counts_of(spark, "b", [1, 1]) + [("c", "other", 5)]
    df = spark.createDataFrame(rows, "split string, label string, count bigint")
    got = {(r[0], r[1]): (r[2], r[3]) for r in js_divergence(df).collect()}
    assert got["a", "b"] == (0.0, 0.0)
    ln2 = 0.6931471805599453
    assert got["a", "c"] == pytest.approx((ln2, ln2 ** 0.5))


# Published label counts per split, labels in index order.
PUBLISHED = {
    "train": [83905, 303932, 160954, 58607, 147700, 331128, 95845, 307167, 95232, 42910, 294782,
              70975, 83057, 37078, 61752, 82583, 174421, 397812, 43168, 25765, 140764, 40521,
              36956, 102971, 110125],
    "val": [10381, 38062, 20190, 7439, 18324, 41324, 12186, 38767, 11892, 5337, 36950, 8779, 10408,
            4580, 7907, 10291, 21629, 49748, 5452, 3229, 17384, 5090, 4724, 12997, 13594],
    "test": [10378, 38026, 20102, 7176, 18588, 41207, 12058, 38763, 11867, 5182, 37067, 8905, 10639,
             4742, 7713, 10167, 21760, 49645, 5525, 3273, 17523, 4932, 4673, 12777, 13787],
}


def test_published_split_drift(spark):
    """Published label counts of the three splits and the drift computed from them."""
    rows = [row for split, numbers in PUBLISHED.items() for row in counts_of(spark, split, numbers)]
    df = spark.createDataFrame(rows, "split string, label string, count bigint")
    got = {(r[0], r[1]): r for r in js_divergence(df).collect()}
    want = {("train", "val"): (8.4556e-06, 0.002908), ("test", "train"): (1.1430e-05, 0.003381),
            ("test", "val"): (1.6432e-05, 0.004054)}
    for pair, (divergence, distance) in want.items():
        assert got[pair]["js_divergence"] == pytest.approx(divergence, rel=1e-4)
        assert got[pair]["js_distance"] == pytest.approx(distance, abs=5e-7)
    totals = {r[0]: r[1] for r in df.groupBy("split").agg(F.sum("count")).collect()}
    assert totals == {"train": 3330110, "val": 416664, "test": 416475}


def test_top_bottom_and_alignment(spark):
    df = spark.createDataFrame([("x", 5), ("y", 3), ("z", 3)], "label string, count bigint")
    rows = top_bottom(df, 2).orderBy("position").collect()
    assert [tuple(r) for r in rows] == [(1, "x", 5, "y", 3), (2, "y", 3, "z", 3)]
    other = spark.createDataFrame([("x", 1), ("w", 2)], "label string, count bigint")
    got = sorted(tuple(r) for r in align_distributions(df, other).collect())
    assert got == [("w", 0, 2), ("x", 5, 1), ("y", 3, 0), ("z", 3, 0)]


def test_hot_label_counts_combine_before_the_shuffle(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.array(F.lit("hot"))).otherwise(
            F.array(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))).alias("labels"))
    plan = label_distribution(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
    assert label_distribution(df).where("label = 'hot'").first()["count"] == 3000


def test_scratch_folder_is_the_named_one(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_train_job_on_a_sample(spark, ready, tmp_path):
    from labelmill.operators.linear_model import LinearModel, pos_weight
    from labelmill.operators.sampling import sample_train_val
    from labelmill.plans.training import train_job

    papers, _ = ready
    out = str(tmp_path / "trained")
    model, report = train_job(papers, out, ratio=0.5, seed=3)
    train, _ = sample_train_val(papers, 0.5, 3)
    want = {r["idx"]: r["pos_weight"] for r in pos_weight(train).collect()}
    assert {r["idx"]: r["pos_weight"] for r in model.bias.collect()} == pytest.approx(want)
    rows = {r["split"]: r for r in report.collect()}
    assert set(rows) == {"train", "val"} and rows["train"]["f1"] > rows["val"]["f1"]
    again = LinearModel.load(spark, f"{out}/model")
    some = papers.limit(5)
    a = sorted(map(str, score_linear(some, model).collect()))
    assert a == sorted(map(str, score_linear(some, again).collect()))
    assert json.loads(spark.read.text(f"{out}/settings").first()[0])["seed"] == 3


def test_rejects_of_a_snapshot_are_written(spark, tmp_path):
    (tmp_path / "papers.json").write_text('{"id": "1", "title": "a", "abstract": "b", "categories": "cs.CV"}\n{broken\n')
    raw = readers.read_papers_jsonl(spark, str(tmp_path / "papers.json"), keep_bad=True)
    stages = prep.prep_job(raw, str(tmp_path / "out"))
    assert stages["taxonomy"].count() == 1
    assert json.loads(spark.read.text(str(tmp_path / "out" / "rejects")).first()[0])["raw_line"] == "{broken"


def test_no_exchange_and_no_explode_where_a_row_will_do(spark):
    from labelmill.functions.taxonomy import code_dim
    from labelmill.operators import metrics, profiling

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    scored = V.scored(spark, SF)
    for df in (metrics.confusion(scored, 0.5), metrics.weighted_bce(scored, F.array(*[F.lit(1.0)] * 25))):
        before = plan(df).split("Aggregate", 2)[-1]
        assert "Generate explode(arrays_zip" not in before and "Generate posexplode(arrays_zip" not in before
    papers = spark.createDataFrame([("x", ["cs.CV", "cs.CV"]), ("x", ["cs.CL", "cmp-lg"])], "id string, categories array<string>")
    joined = profiling.join_codes(papers, code_dim(spark))
    assert "Exchange hash" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["label"] for r in joined.collect()) == ["Computer Vision", "Natural Language Processing"]


def test_large_limit_uses_no_single_task(spark, monkeypatch):
    from labelmill.operators import sampling

    df = spark.range(5000).selectExpr("cast(id AS string) AS id", "'text' AS text").repartition(7)
    want = sorted(str(i) for i in range(5000))[:777]
    monkeypatch.setattr(sampling, "ONE_TASK_ROWS", 10)
    assert sorted(r["id"] for r in sampling.limit_records(df, 777).collect()) == want
    assert sampling.limit_records(df, 777, None).count() == 777
    assert sampling.limit_records(df, 777).columns == ["id", "text"]
    assert sampling.limit_records(df, 5001).count() == sampling.limit_records(df, 5001, None).count() == 5000
    odd = spark.createDataFrame([(None,)] * 30 + [("x",)] * 40 + [("y",)] * 50, "id string").repartition(5)
    for n in (20, 30, 31, 69, 70, 75, 119):
        found = [r["id"] for r in sampling.limit_records(odd, n).collect()]
        assert len(found) == n and found.count(None) == min(30, n) and found.count("x") == min(40, max(0, n - 30))
        assert sampling.limit_records(odd, n, None).count() == n


def test_a_large_limit_writes_nothing_but_keys(spark, monkeypatch):
    from labelmill.operators import rows, sampling

    wrote = []
    monkeypatch.setattr(sampling, "ONE_TASK_ROWS", 10)
    monkeypatch.setattr(rows, "stored", lambda df, name: wrote.append(df.columns) or stored(df, name))
    df = spark.range(500).selectExpr("cast(id AS string) AS id", "repeat('text', 50) AS text")
    out = sampling.limit_records(df, 100)
    assert out.count() == 100 and wrote and all("text" not in columns for columns in wrote)


def test_texts_are_split_once_with_a_tail(spark, monkeypatch):
    from labelmill.operators import lookup, vocab

    wrote = []
    monkeypatch.setattr(lookup, "stored", lambda df, name: wrote.append(df) or stored(df, name))
    papers = spark.createDataFrame([("1", "a b c d", "a a b zz"), ("1", "d e", ""), ("2", None, None)], "id string, title string, abstract string")
    table = stored(vocab.build_vocab(papers.where("title <> 'd e'")), "vocab")
    plain = sorted(map(str, vocab.encode_pairs(papers, table, key=None).collect()))
    out = vocab.encode_pairs(papers, table, head_rows=2)
    assert sorted(map(str, out.collect())) == plain
    plan = wrote[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1
    # What follows reads the written lists, not the texts.
    rest = out._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in rest and set(wrote[0].columns) == {"__row", "__known", "__rest", "first_len"}


def test_large_code_tables_are_looked_up(spark):
    from labelmill.operators import profiling

    rows = [("x", ["a", "b", "a", "zz"]), ("x", ["c", None]), ("y", []), ("z", None), ("w", ["d"])]
    df = spark.createDataFrame(rows, "id string, categories array<string>")
    codes = spark.createDataFrame([("a", "A"), ("b", "A"), ("c", "C"), ("d", None), ("e", "E")], "code string, label string")
    want = sorted(map(tuple, profiling.join_codes(df, codes).collect()))
    assert want == [("x", "A"), ("x", "C")]
    for head in (None, 0, 1, 3):
        assert sorted(map(tuple, profiling.join_codes(df, codes, map_bytes=0, head_rows=head).collect())) == want


def test_jobs_take_a_key_and_write_no_numbered_rows(spark, tmp_path, monkeypatch):
    from labelmill.operators import linear_model, vocab
    from labelmill.plans import training

    raw = V.papers_raw(spark, SF)
    plain = prep.prep_job(raw, str(tmp_path / "a"), vocab_size=500)
    told = json.loads((tmp_path / "a" / "retention").read_text())
    assert told["papers"] == raw.count() and told["labelled"] == plain["taxonomy"].count()
    assert told["percent"] == pytest.approx(100 * told["labelled"] / told["papers"])

    def fails(*_):
        raise AssertionError("the rows were written with a number")

    monkeypatch.setattr(vocab, "numbered", fails)
    monkeypatch.setattr(linear_model, "numbered", fails)
    keyed = prep.prep_job(raw, str(tmp_path / "b"), vocab_size=500, key="id", write_base=False)
    assert sorted(map(str, keyed["encoded"].collect())) == sorted(map(str, plain["encoded"].collect()))
    assert json.loads((tmp_path / "b" / "retention").read_text()) == told
    papers = prep.with_y(keyed["taxonomy"])
    model, _ = training.train_job(papers, str(tmp_path / "m"), key="id")
    evaluation.tune_job(papers, model, str(tmp_path / "m" / "model" / "thresholds"), key="id")
    report = evaluation.eval_job(papers, model, str(tmp_path / "m" / "model"), str(tmp_path / "report"), key="id")
    assert json.loads((tmp_path / "report").read_text())["f1"] == pytest.approx(report.first()["f1"])


def test_run_folder_is_removed_at_the_end(spark, tmp_path):
    from labelmill.session import remove_run, run_folder

    with run_folder(spark) as path:
        table = stored(spark.range(5), "inside")
        assert readers.path_exists(spark, path) and table.count() == 5
    assert not readers.path_exists(spark, path)
    assert not scratch_path(spark, "x").startswith(path)
    with pytest.raises(ValueError):
        remove_run(spark, str(tmp_path))
