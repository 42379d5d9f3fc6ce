import json
import math
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from labelmill.operators import linear_model as L
from labelmill.operators import logreg
from labelmill.operators import lookup as lookups
from labelmill.operators.logreg import LogRegModel, feature_frame, fit_steps, hashed_words, score_logreg, train_logreg
from labelmill.operators.lookup import lookup, most_frequent
from labelmill.operators.plugged import score_plugged
from labelmill.operators.vocab import build_vocab, decode_tokens, encode_pairs
from labelmill.plans.training import gradient_job, load_best
from labelmill.registry import model_queries
from labelmill.session import stored

NAMES = ["a", "b", "c"]
WORDS = {"a": "apple apricot", "b": "boat bridge", "c": "cloud"}


def corpus(spark, n=120):
    rows = []
    for i in range(n):
        y = [float(i % 2 == 0), float(i % 3 == 0), 0.0]
        text = " ".join(WORDS[x] for x, v in zip(NAMES, y) if v) + f" the common w{i % 10}"
        rows.append((str(i), f"The {i % 4}", text, y))
    return spark.createDataFrame(rows, "id string, title string, abstract string, y array<double>")


def bag(title, abstract):
    return {w for w in f"{title} {abstract}".lower().split(" ") if w}


def brute(rows, min_papers=1, a=1.0):
    """Weights, biases and scores by the definition, in plain Python."""
    n, k = len(rows), len(NAMES)
    pos = [sum(r["y"][c] for r in rows) for c in range(k)]
    df, inside = Counter(), Counter()
    for r in rows:
        for w in bag(r["title"], r["abstract"]):
            df[w] += 1
            for c in range(k):
                inside[w, c] += r["y"][c]
    weights = {
        w: [math.log((inside[w, c] + a) / (pos[c] + 2 * a))
            - math.log((d - inside[w, c] + a) / (n - pos[c] + 2 * a)) for c in range(k)]
        for w, d in df.items() if d >= min_papers
    }
    bias = [math.log((p + a) / (n - p + a)) + math.log(math.sqrt((n - p) / max(p, 1)))
            for p in pos]

    def score(title, abstract):
        known = [weights[w] for w in bag(title, abstract) if w in weights]
        scale = max(math.sqrt(len(known)), 1.0)
        return [sum(w[c] for w in known) / scale + bias[c] for c in range(k)]

    return weights, bias, score


@pytest.fixture(scope="module")
def trained(spark):
    papers = corpus(spark).cache()
    return papers, L.train_linear(papers, NAMES).stored()


def test_training_against_the_definition(trained):
    papers, model = trained
    weights, bias, _ = brute(papers.collect())
    got = {r["token"]: r["w"] for r in model.weights.collect()}
    assert got.keys() == weights.keys()
    for w in weights:
        assert got[w] == pytest.approx(weights[w])
    rows = model.bias.orderBy("idx").collect()
    assert [r["label"] for r in rows] == NAMES
    assert [r["b"] for r in rows] == pytest.approx(bias)


@pytest.mark.parametrize("head_rows", [50_000, 3])
def test_scores_against_the_definition(spark, trained, head_rows):
    papers, model = trained
    _, bias, score = brute(papers.collect())
    new = spark.createDataFrame(
        [("x", "Apple boat", "the the cloud"), ("y", "", None), ("z", "unseen words", "only")],
        "id string, title string, abstract string")
    both = papers.drop("y").unionByName(new).repartition(5)
    got = {r["id"]: r["logit"] for r in L.score_linear(both, model, head_rows=head_rows).collect()}
    for r in both.collect():
        assert got[r["id"]] == pytest.approx(score(r["title"], r["abstract"] or ""), abs=1e-8)
    assert got["y"] == pytest.approx(bias) and got["z"] == pytest.approx(bias)


@pytest.mark.parametrize("head_rows", [None, 3])
def test_rows_with_one_id_are_scored_apart(spark, trained, head_rows):
    """A third of all rows share an id, under two texts."""
    papers, model = trained
    _, _, score = brute(papers.collect())
    texts = [("apple", "the boat"), ("cloud", "bridge unseen")]
    hot = spark.createDataFrame([("hot", *texts[i % 2]) for i in range(60)],
                                "id string, title string, abstract string")
    both = papers.drop("y").unionByName(hot)
    many = L.score_linear(both, model, head_rows=head_rows).where("id = 'hot'").collect()
    want = [[round(x, 6) for x in score(*t)] for t in texts]
    got = Counter(str([round(x, 6) for x in r["logit"]]) for r in many)
    assert got == {str(w): 30 for w in want}


def test_encoding_keeps_rows_with_one_id_apart(spark):
    df = spark.createDataFrame([("x", "a b", "c"), ("x", "b", "a a"), ("x", "b", "a a")],
                               "id string, title string, abstract string")
    vocab = build_vocab(df)
    text = decode_tokens(encode_pairs(df, vocab, 16), vocab).collect()
    assert sorted(r["text"] for r in text) == [
        "[CLS] a b [SEP] c [SEP]", "[CLS] b [SEP] a a [SEP]", "[CLS] b [SEP] a a [SEP]"]


def test_token_rows_stay_narrow(spark, trained):
    papers, model = trained
    vocab = build_vocab(papers)
    for made in (encode_pairs(papers, vocab, 64, ("y",), key="id"), L.score_linear(papers, model, "id", ("id", "y"))):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.split("\n"):
            if "Generate explode" in line or "Generate posexplode" in line:
                assert "y#" not in line
        assert plan.count("Generate") == 1


def test_vocabulary_has_every_word(spark):
    df = spark.range(3000).selectExpr("cast(id AS string) AS id", "concat('w', id, ' x') AS title", "'x' AS abstract")
    rows = build_vocab(df).collect()
    assert len(rows) == 3005 and sorted(r["token_id"] for r in rows) == list(range(3005))
    by_id = [r["token"] for r in sorted(rows, key=lambda r: r["token_id"])][4:]
    assert by_id == ["x", *sorted(f"w{i}" for i in range(3000))]
    assert L.train_linear(df.withColumn("y", F.array(F.lit(1.0))), ["a"]).weights.count() == 3001


def test_model_survives_saving(spark, trained, tmp_path):
    papers, model = trained
    path = str(tmp_path / "m")
    model.save(path)
    loaded = L.LinearModel.load(spark, path, NAMES)
    a = sorted((r["id"], r["logit"]) for r in L.score_linear(papers, model).collect())
    assert a == sorted((r["id"], r["logit"]) for r in L.score_linear(papers, loaded).collect())


def test_scores_separate_the_classes(trained):
    papers, model = trained
    rows = L.score_linear(papers, model, keep=("id", "y")).collect()
    for c in (0, 1):
        hit = [r["prob"][c] for r in rows if r["y"][c]]
        miss = [r["prob"][c] for r in rows if not r["y"][c]]
        assert min(hit) > max(miss)
    assert max(r["prob"][2] for r in rows) < 0.5


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("head_rows", [0, 1, 2, 100])
def test_lookup_equals_the_plain_join(spark, how, head_rows):
    rows = spark.createDataFrame(
        [(i, "hot") for i in range(60)] + [(100 + i, f"k{i % 7}") for i in range(30)]
        + [(200, None), (201, "absent")], "n int, k string")
    table = spark.createDataFrame(
        [("hot", 60, 1), *[(f"k{i}", 4, i) for i in range(5)]], "k string, f int, v int")
    want = rows.join(table, "k", how)
    got = lookup(rows, table, "k", "f", how, head_rows=head_rows)
    columns = ("n", "k", "f", "v")
    assert sorted(map(str, got.select(*columns).collect())) == sorted(
        map(str, want.select(*columns).collect()))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 50])
def test_most_frequent(spark, n):
    rows = [("a", 5), ("b", 3), ("c", 3), ("d", 3), ("e", 1), ("f", 1)]
    df = spark.createDataFrame(rows, "k string, f int").repartition(4)
    got = most_frequent(df, "f", "k", n).collect()
    assert [tuple(r) for r in got] == rows[:n]


def test_vocab(spark):
    df = spark.createDataFrame([("B a", "b http://x c"), ("b", "a")],
                               "title string, abstract string")
    rows = [tuple(r) for r in build_vocab(df, 2).orderBy("token_id").collect()]
    assert rows == [("[PAD]", 0, 0), ("[UNK]", 1, 0), ("[CLS]", 2, 0), ("[SEP]", 3, 0),
                    ("b", 4, 3), ("a", 5, 2)]


def trimmed(t, a, room):
    """Longest side first, then both evenly with the longer keeping the odd one."""
    if len(t) + len(a) <= room:
        return t, a
    short, long_ = sorted((len(t), len(a)))
    if short <= room // 2:
        keep_short, keep_long = short, room - short
    else:
        keep_short, keep_long = room // 2, room - room // 2
    if len(t) <= len(a):
        return t[:keep_short], a[:keep_long]
    return t[:keep_long], a[:keep_short]


@pytest.mark.parametrize("head_rows", [50_000, 4])
def test_encode_and_decode(spark, head_rows):
    cases = [("a b", "c"), ("", ""), ("a " * 3, "b " * 30), ("a " * 30, "b " * 3),
             ("a " * 9, "b " * 9), ("a " * 20, "b " * 21), ("zz a", "zz"), ("a " * 8, "b " * 40)]
    df = spark.createDataFrame([(str(i), t, a, i) for i, (t, a) in enumerate(cases)],
                               "id string, title string, abstract string, extra int")
    vocab = build_vocab(spark.createDataFrame([("a b c", "a b a")], "title string, abstract string"))
    enc = encode_pairs(df, vocab, 16, ("extra",), head_rows).cache()
    text = {r["id"]: r["text"] for r in decode_tokens(enc, vocab, head_rows=head_rows).collect()}
    for r in enc.collect():
        t, a = (s.split() for s in cases[int(r["id"])])
        t, a = trimmed(t, a, 13)
        words = ["[UNK]" if w == "zz" else w for w in [*t, "[SEP]", *a]]
        assert text[r["id"]] == " ".join(["[CLS]", *words, "[SEP]"])
        assert r["token_type_ids"] == [0] * (len(t) + 2) + [1] * (len(a) + 1)
        assert r["attention_mask"] == [1] * len(r["input_ids"]) and len(r["input_ids"]) <= 16
        assert r["extra"] == int(r["id"])


def test_logistic_regression(spark, tmp_path):
    papers = corpus(spark, 60)
    steps = []
    train_logreg(papers, NAMES, features=64, on_step=steps.append).save(spark, str(tmp_path / "lr"))
    model = LogRegModel.load(spark, str(tmp_path / "lr"), NAMES)
    assert model.fitted == [True, True, False]  # class c has no positives
    for r in score_logreg(papers, model, ("id", "y")).collect():
        assert [p > 0.5 for p in r["prob"]] == [v == 1.0 for v in r["y"]]
        assert r["prob"][2] == 0.0 and all(math.isfinite(x) for x in r["logit"])
    losses = [s.loss[:2] for s in steps]
    assert all((b <= a + 1e-12).all() for a, b in zip(losses, losses[1:])) and (losses[-1] < losses[0] / 4).all()
    with pytest.raises(ValueError):
        LogRegModel.load(spark, str(tmp_path / "lr"), ["a"])


def noisy_corpus(spark, n=300):
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        own = [words[j] for j in np.flatnonzero(r.random(40) < 0.3 / (1 + np.arange(40) / 8))]
        y = [float(r.random() < (0.7 if f"w{c}" in own else 0.1 + 0.1 * c)) for c in range(3)]
        rows.append((str(i), "every", " ".join(own), y))
    rows += [("empty", "", "", [0.0, 1.0, 0.0]), ("0", None, None, [1.0, 0.0, 0.0])]
    return spark.createDataFrame(rows, "id string, title string, abstract string, y array<double>").repartition(3)


def test_joint_fit_reaches_the_loss_of_separate_fits(spark):
    papers, features, reg = noisy_corpus(spark), 128, 1e-3
    weight = np.array([r["pos_weight"] for r in sorted(L.pos_weight(papers, NAMES).collect())])
    joint = train_logreg(papers, NAMES, features=features, reg=reg)
    rows = papers.select(hashed_words(features).alias("at"), "y").collect()
    x = np.zeros((len(rows), features))
    for i, r in enumerate(rows):
        x[i, r["at"]] = 1
    y = np.array([r["y"] for r in rows])
    for c in range(3):
        data = spark.createDataFrame(
            [(Vectors.dense(v), float(t), float(weight[c] if t else 1)) for v, t in zip(x, y[:, c])], ["features", "label", "weight"])
        single = LogisticRegression(weightCol="weight", maxIter=300, tol=1e-9, regParam=reg).fit(data)
        own = np.where(y[:, c] == 1, weight[c], 1.0)
        mean = (own[:, None] * x).sum(0) / own.sum()
        spread = (own[:, None] * (x - mean) ** 2).sum(0) / (own.sum() - (own**2).sum() / own.sum())

        def loss(coef, bias, y=y[:, c], own=own, spread=spread):
            z = x @ coef + bias
            return (own * (np.logaddexp(0, z) - y * z)).sum() / own.sum() + reg / 2 * (spread * coef**2).sum()

        theirs, ours = loss(single.coefficients.toArray(), single.intercept), loss(joint.coef[:, c], joint.bias[c])
        assert abs(ours - theirs) < 1e-3 and ours > theirs - 1e-6


def test_a_class_that_has_stopped_is_no_longer_summed(spark, monkeypatch):
    """The passes after it has stopped are about the others alone, and every step's model is that of a fit that holds all."""
    r, rows = np.random.default_rng(2), noisy_corpus(spark, 200).collect()
    more = [0.0, 1.0, None]  # of a class by chance, of one with all papers and of one by a word
    papers = spark.createDataFrame([(x["id"], x["title"], x["abstract"], [*x["y"], float(r.random() < 0.5), *more[:2], float("w1 " in (x["abstract"] or ""))])
                                    for x in rows], "id string, title string, abstract string, y array<double>").repartition(3)
    names, frame = [f"c{i}" for i in range(7)], feature_frame(papers, 64)
    y = np.array([x["y"] for x in papers.collect()])
    weight, positive = np.linspace(0.5, 2, 7), y.sum(0)
    wanted = (positive > 0) & (positive < len(y))
    sent, slopes = [], logreg._Pass.slopes
    monkeypatch.setattr(logreg._Pass, "slopes", lambda self, coef, bias: sent.append(coef.shape[1]) or slopes(self, coef, bias))
    steps = list(fit_steps(frame, weight, positive, wanted, names, 64, tol=1e-3))
    first, sent[:] = list(sent), []
    monkeypatch.setattr(logreg, "STOPPED", 0.0)
    whole = list(fit_steps(frame, weight, positive, wanted, names, 64, tol=1e-3))
    assert set(sent) == {7} and first[0] == 7 and first[-1] < 5 and first == sorted(first, reverse=True)
    assert list(wanted) == [True] * 4 + [False] * 2 + [True] and len(steps) == len(whole)
    for ours, theirs in zip(steps, whole):
        a, b = ours.model(), theirs.model()
        assert (ours.moving == theirs.moving).all() and np.allclose(ours.loss, theirs.loss) and np.allclose(ours.length, theirs.length)
        assert np.allclose(a.coef, b.coef, atol=1e-6) and np.allclose(a.bias, b.bias, atol=1e-6) and a.fitted == b.fitted


def test_an_iteration_is_one_job(spark):
    papers = noisy_corpus(spark, 60)
    frame = feature_frame(papers, 128)
    weight, wanted = np.ones(3), np.array([True, True, True])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("joint-fit", "steps")
    try:
        steps = list(fit_steps(frame, weight, np.full(3, 20), wanted, NAMES, 128, max_iter=5))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # One for the weights, and each job's shuffle counts as one of its own under adaptive execution.
    assert len(tracker.getJobIdsForGroup("joint-fit")) <= 2 * (len(steps) + 1)


def test_every_pass_is_logged_and_the_best_is_given(spark, tmp_path):
    papers = noisy_corpus(spark).withColumn("split", F.when(F.crc32("id") % 4 == 0, "val").otherwise("train"))
    out = str(tmp_path / "own")
    model, log = gradient_job(papers, out, passes=6, every=2, labels=NAMES, features=128, tol=0.0)
    rows = sorted((r["step"], r["loss"] is None) for r in log.collect())
    assert rows == [(2, False), (2, True), (4, False), (4, True), (6, False), (6, True)]
    state = json.loads((tmp_path / "own" / "state.json").read_text())
    f1 = {h["step"]: h["eval_f1"] for h in state["log_history"] if h["eval_f1"] is not None}
    assert state["best_metric"] == max(f1.values()) and state["best_global_step"] == min(s for s, v in f1.items() if v == max(f1.values()))
    kept = LogRegModel.load(spark, f"{out}/checkpoint-{state['best_global_step']}/weights", NAMES)
    assert (kept.coef == model.coef).all() and (kept.bias == model.bias).all()
    half = json.loads((tmp_path / "own" / "checkpoint-4" / "state.json").read_text())
    assert half["log_history"] == state["log_history"][:4]  # a run that dies keeps the log so far
    state["best_global_step"] = 999
    (tmp_path / "own" / ".state.json.crc").unlink(missing_ok=True)
    (tmp_path / "own" / "state.json").write_text(json.dumps(state))
    with pytest.raises(ValueError):
        load_best(spark, out, NAMES)
    with pytest.raises(FileNotFoundError):
        load_best(spark, str(tmp_path), NAMES)


def test_a_run_with_nothing_to_fit_has_a_log_too(spark, tmp_path):
    papers = noisy_corpus(spark, 20).withColumn("split", F.lit("val"))
    model, log = gradient_job(papers, str(tmp_path / "x"), labels=NAMES, features=16)
    assert model.fitted == [False] * 3 and log.count() == 2


def test_rare_and_full_classes_are_left_out(spark):
    rows = [(str(i), "a b", f"w{i}", [1.0, 0.0, float(i < 2)]) for i in range(9)]
    papers = spark.createDataFrame(rows, "id string, title string, abstract string, y array<double>")
    model = train_logreg(papers, NAMES, features=32)
    assert model.fitted == [False, False, True]
    none = train_logreg(papers.limit(0), NAMES, features=32)
    assert none.fitted == [False] * 3 and score_logreg(papers, none).first()["prob"] == [0.0] * 3


def test_plugged_model_does_not_depend_on_batches(spark):
    def make_predict():
        weights = np.arange(6, dtype=float).reshape(3, 2) / 10
        return lambda x: x @ weights

    df = spark.createDataFrame([(i, [float(i), 1.0, -float(i)]) for i in range(50)],
                               "id int, v array<double>").repartition(3)
    out = [
        sorted((r["id"], tuple(round(x, 9) for x in r["logit"])) for r in score_plugged(
            df, make_predict, [F.col("v")], batch_size=b, input_shapes=[[3]]).collect())
        for b in (1, 7, 64)
    ]
    assert out[0] == out[1] == out[2]
    assert out[0][2][1] == pytest.approx((0.2 - 0.8, 0.3 + 0.2 - 1.0))


def test_a_plugged_model_needs_no_folder_on_the_workers(spark, tmp_path, monkeypatch):
    """A cluster takes no local folder as a file."""
    def refused(*_, **__):
        raise ValueError("addFile does not support local directories when not running local mode")

    monkeypatch.setattr(type(spark.sparkContext), "addFile", refused)
    spark.createDataFrame([(i, 10 * (i % 2), [float(i), 1.0]) for i in range(6)],
                          "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = model_queries.plugged(spark, str(tmp_path), 4).collect()
    got = {(r["vec_id"], r["idx"]): r["logit"] for r in rows}
    assert got == {(i, label): pytest.approx(mean * i + 1) for i in range(6) for label, mean in ((0, 2.0), (10, 3.0))}


def test_a_head_of_the_model_is_met_without_a_sort(spark, trained, monkeypatch):
    """Beside a tail, the words of the head are summed in the row: no aggregate of lists, no exchange."""
    papers, model = trained
    plans = []
    monkeypatch.setattr(L, "stored", lambda df, name: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or stored(df, name))
    rows = L.score_linear(papers, model, head_rows=3)
    assert len(plans) == 1 and "Aggregate" not in plans[0] and "Exchange" not in plans[0]
    assert sorted(r["id"] for r in rows.collect()) == sorted(r["id"] for r in papers.collect())


@pytest.mark.parametrize("head_rows", [None, 4])
def test_ids_beyond_the_head_are_gathered_without_a_sort(spark, monkeypatch, head_rows):
    df = spark.createDataFrame([("x", "a b", "c d e"), ("y", "b b", "zz a a"), ("z", "", None)],
                               "id string, title string, abstract string")
    vocab = stored(build_vocab(df.where("id = 'x'")), "vocab")
    plans = []
    monkeypatch.setattr(lookups, "stored", lambda part, name: plans.append(
        part._jdf.queryExecution().executedPlan().toString()) or stored(part, name))
    encoded = encode_pairs(df, vocab, 16, head_rows=head_rows)
    text = {r["id"]: r["text"] for r in decode_tokens(encoded, vocab, head_rows=head_rows).collect()}
    assert text == {"x": "[CLS] a b [SEP] c d e [SEP]", "y": "[CLS] b b [SEP] [UNK] a a [SEP]", "z": "[CLS] [SEP] [SEP]"}
    assert len(plans) == (0 if head_rows is None else 2)
    assert not any("Aggregate" in p for p in plans)


def test_steps_of_a_fit_are_not_held_in_memory():
    n, k = 20_000, 5
    rng = np.random.default_rng(1)
    tracemalloc.start()
    kept = logreg._Curvature(n, k)
    for _ in range(logreg.MEMORY + 2):
        step = rng.normal(size=(n, k))
        kept.add(step, 2 * step, np.arange(k) > 0)
    down = kept.direction(step)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < logreg.MEMORY * step.nbytes
    assert np.allclose(down[:, 0], -step[:, 0]) and np.allclose(down[:, 1:], -step[:, 1:] / 2)


@pytest.mark.parametrize("head_rows", [None, 4])
def test_encoding_splits_a_text_once_and_writes_no_texts(spark, monkeypatch, head_rows):
    from labelmill.operators import vocab as encoder

    df = spark.createDataFrame([("x", "a b", "c d e", 1), (None, "b b", "zz a a", 2), (None, "b b", "zz a a", 2)],
                               "id string, title string, abstract string, token int")
    table = stored(build_vocab(df.where("id = 'x'")), "vocab")
    plans = []
    noted = lambda part, name: plans.append(part) or stored(part, name)
    monkeypatch.setattr(lookups, "stored", noted)
    monkeypatch.setattr(encoder, "numbered", lambda rows: noted(rows, "rows"))
    made = encode_pairs(df, table, 16, ("token",), head_rows=head_rows)
    assert len(plans) == (0 if head_rows is None else 1)
    plan = (plans[0] if plans else made)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(") <= 4  # title and abstract, for the words and for the length of the title
    ids = {r["token"]: r["token_id"] for r in table.collect()}
    want = [[ids.get(w, 1) for w in f"[CLS] {text} [SEP]".split()]
            for text in ("a b [SEP] c d e", "b b [SEP] zz a a", "b b [SEP] zz a a")]
    assert sorted((r["token"], r["input_ids"]) for r in made.collect()) == [(1, want[0]), (2, want[1]), (2, want[2])]
