"""Train, score, tag, tune and evaluate; pluggable models; the tagging stream."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from labelmill import schemas as S
from labelmill.functions.taxonomy import has_label, label_name
from labelmill.operators import curves
from labelmill.operators.blocked import score_blocked
from labelmill.operators.linear_model import pos_weight, score_linear, train_linear
from labelmill.operators.logreg import LogRegModel, score_logreg, train_logreg
from labelmill.operators.metrics import confusion, report
from labelmill.operators.plugged import score_plugged
from labelmill.operators.rows import ROW, numbered
from labelmill.plans import evaluation, tagging, training
from labelmill.registry import views as V
from labelmill.registry.base import ORACLES, query
from labelmill.registry.metric_queries import POLICY_SQL, rounded
from labelmill.registry.sql_views import sql
from labelmill.session import scratch_path, stored
from labelmill.sources import readers
from labelmill.sources.files import files_in
from labelmill.streaming import tagging as stream


def model_of(papers):
    return train_linear(papers.where(F.col("split") == "train"))


def whole_corpus(spark, sf):
    """All papers, numbered and written once, and the model of the labelled ones, written too.

    A label is needed to learn from a paper, not to tag it.
    """
    papers = numbered(V.all_papers(spark, sf), "papers")
    return papers, model_of(papers.where(has_label(F.col("labels")))).stored()


def corpus(spark, sf):
    """The labelled papers and their model."""
    papers, model = whole_corpus(spark, sf)
    return papers.where(has_label(F.col("labels"))), model


def model_alone(spark, sf):
    """The model of the labelled papers, written, for records from elsewhere: no paper is."""
    return model_of(V.papers(spark, sf)).stored()


@query("train_linear", sql("""
    SELECT token, label, round(w, 6) AS w FROM weights
    UNION ALL SELECT '', label, round(b, 6) FROM bias"""))
def train_linear_query(spark, sf):
    model = model_of(V.papers(spark, sf))
    long = model.weights.select("token", F.posexplode("w").alias("idx", "w"))
    rows = long.select("token", label_name(F.col("idx")).alias("label"), "w")
    bias = model.bias.select(F.lit("").alias("token"), "label", F.col("b").alias("w"))
    return rounded(rows.unionByName(bias))


@query("score_papers", sql("""
    SELECT id, idx, round(prob, 6) AS prob FROM linear_scores"""))
def score_papers(spark, sf):
    papers, model = whole_corpus(spark, sf)
    scored = score_linear(papers, model, key=ROW)
    return rounded(scored.select("id", F.posexplode("prob").alias("idx", "prob")))


@query("tag_papers", sql("""
    SELECT p.id, p.title, p.labels AS true_tags,
           coalesce(string_agg(s.label, '|' ORDER BY s.idx) FILTER (prob > 0.5), '') AS predicted,
           round(coalesce(sum(round(prob, 4)) FILTER (prob > 0.5), 0), 4) AS total_prob
    FROM all_papers p JOIN linear_scores s ON s.id = p.id GROUP BY p.id, p.title, p.labels"""))
def tag_papers(spark, sf):
    papers, model = whole_corpus(spark, sf)
    tagged = tagging.tag_papers(papers, model, key=ROW)
    total = F.aggregate(F.map_values("tag_probabilities"), F.lit(0.0), lambda a, x: a + x)
    return tagged.select(
        "id", "title", V.text_of("labels").alias("true_tags"),
        V.text_of("predicted_tags").alias("predicted"), F.round(total, 4).alias("total_prob"))


@query("tag_repeated_ids", sql("""
    SELECT p.source AS id, p.title,
           coalesce(string_agg(s.label, '|' ORDER BY s.idx) FILTER (prob > 0.5), '') AS predicted
    FROM all_papers p JOIN linear_scores s ON s.id = p.id GROUP BY p.id, p.source, p.title"""))
def tag_repeated_ids(spark, sf):
    """Every row is tagged for itself, though 20 ids stand for all papers."""
    papers, model = whole_corpus(spark, sf)
    source = V.papers_source(spark, sf).select(F.col("id").alias("own"), F.col("source").alias("new"))
    rows = papers.drop(ROW).join(source, F.col("id") == F.col("own"))
    rows = rows.withColumn("id", F.col("new")).drop("own", "new")
    return tagging.tag_papers(rows, model).select("id", "title", V.text_of("predicted_tags").alias("predicted"))


@query("score_with_tail", sql("""
    SELECT id, idx, round(prob, 6) AS prob FROM linear_scores"""))
def score_with_tail(spark, sf):
    """The same scores when only 500 words of the model are broadcast."""
    papers, model = whole_corpus(spark, sf)
    scored = score_linear(papers, model, key=ROW, head_rows=500)
    return rounded(scored.select("id", F.posexplode("prob").alias("idx", "prob")))


@query("predictions_full", sql("""
    SELECT coalesce(r.id, '') AS id, r.title, coalesce(r.abstract, '') AS abstract,
           coalesce(t.predicted, '') AS predicted
    FROM shaped r JOIN (
        SELECT paper, string_agg(label, '|' ORDER BY idx) FILTER (prob > 0.5) AS predicted
        FROM record_scores GROUP BY paper) t ON t.paper = r.paper"""))
def predictions_full(spark, sf):
    """Prediction lines with all input columns, read back."""
    model = model_alone(spark, sf)
    out = scratch_path(spark, "predictions")
    tagging.inference_job(V.records(spark, sf), model, out, keep_input=True)
    rows = spark.read.schema("id string, title string, abstract string, predicted_tags array<string>").json(out)
    return rows.select(
        F.coalesce("id", F.lit("")).alias("id"), "title", "abstract", V.text_of("predicted_tags").alias("predicted"))


@query("tune_job", sql("SELECT label, threshold, f1, precision, recall FROM tuned"))
def tune_job(spark, sf):
    papers, model = corpus(spark, sf)
    tuned, _ = evaluation.tune_job(papers, model, scratch_path(spark, "thresholds"))
    return tuned.select("label", "threshold", "f1", "precision", "recall")


@query("tune_comparison", sql(POLICY_SQL.format(source="""
    SELECT 'scalar' AS policy, idx, y, prob > cast(0.35 AS double) AS p
    FROM linear_scores WHERE split = 'val' AND labelled
    UNION ALL SELECT 'per_class', s.idx, y, prob > threshold
    FROM linear_scores s JOIN tuned t ON t.idx = s.idx
    WHERE split = 'val' AND labelled""")))
def tune_comparison(spark, sf):
    papers, model = corpus(spark, sf)
    return rounded(evaluation.tune_job(papers, model)[1])


REPORT_COLUMNS = "f1, f1_weighted, precision, recall, hit_rate, loss"


def report_sql(where: str, threshold: str = "threshold") -> str:
    """The one-row report over the scores that ``where`` (ending in AND) picks."""
    rows = f"""
        SELECT s.*, prob > {threshold} AS p FROM linear_scores s JOIN tuned t ON t.idx = s.idx
        WHERE {where} true"""
    return f"""
        SELECT round(avg(f1), 6) AS f1, round(sum(f1 * support) / sum(support), 6) AS f1_weighted,
               round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
               (SELECT round(avg(hit), 6) FROM (
                    SELECT id, max(case when p AND y = 1 then 1 else 0 end) AS hit
                    FROM ({rows}) GROUP BY id)) AS hit_rate,
               (SELECT round(avg(w * y * (greatest(-logit, 0) + ln(1 + exp(-abs(logit))))
                                 + (1 - y) * (greatest(logit, 0) + ln(1 + exp(-abs(logit))))), 6)
                FROM ({rows}) x JOIN (SELECT idx, sqrt((n - pos) / greatest(pos, 1)) AS w
                                      FROM class_counts) k ON k.idx = x.idx) AS loss
        FROM (SELECT *, case when tp + fp = 0 then 0 else tp / (tp + fp) end AS precision,
                     case when tp + fn = 0 then 0 else tp / (tp + fn) end AS recall,
                     case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end AS f1
              FROM (SELECT idx, count(*) FILTER (p AND y = 1) AS tp,
                           count(*) FILTER (p AND y = 0) AS fp,
                           count(*) FILTER (NOT p AND y = 1) AS fn, sum(y) AS support
                    FROM ({rows}) GROUP BY idx))"""


@query("eval_job", sql(report_sql("split = 'test' AND labelled AND")))
def eval_job(spark, sf):
    papers, model = corpus(spark, sf)
    model_dir = scratch_path(spark, "model")
    model.save(model_dir)
    evaluation.tune_job(papers, model, f"{model_dir}/thresholds")
    return rounded(evaluation.eval_job(papers, model, model_dir, scratch_path(spark, "report")))


@query("inference_job", sql("""
    SELECT count(*) AS papers,
           round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1_micro,
           round(sum(tp) / (sum(tp) + sum(fp)), 6) AS precision_micro,
           round(sum(tp) / (sum(tp) + sum(fn)), 6) AS recall_micro,
           round(avg(case when tp > 0 then 1 else 0 end), 6) AS hit_rate
    FROM (SELECT s.paper, count(*) FILTER (prob > 0.5 AND l.label IS NOT NULL) AS tp,
                 count(*) FILTER (prob > 0.5 AND l.label IS NULL) AS fp,
                 count(*) FILTER (NOT prob > 0.5 AND l.label IS NOT NULL) AS fn
          FROM record_scores s JOIN shaped r ON r.paper = s.paper AND r.labels IS NOT NULL
          LEFT JOIN paper_labels l ON l.id = s.paper AND l.label = s.label
          GROUP BY s.paper)"""))
def inference_job(spark, sf):
    model = model_alone(spark, sf)
    out = scratch_path(spark, "predictions")
    metrics, _ = tagging.inference_job(V.records(spark, sf), model, out)
    return rounded(metrics)


@query("run_summary", "SELECT count(*) AS processed FROM documents")
def run_summary(spark, sf):
    model = model_alone(spark, sf)
    out = scratch_path(spark, "predictions")
    _, summary = tagging.inference_job(V.records(spark, sf), model, out)
    return spark.createDataFrame([(summary["processed"],)], "processed bigint")


@query("train_logreg", sql("""
    SELECT idx, any_value(label) AS label, count(*) AS papers, cast(sum(y) AS bigint) AS positives,
           sum(y) > 0 AND sum(y) < count(*) AS better
    FROM truth WHERE split = 'train' GROUP BY idx"""))
def train_logreg_query(spark, sf):
    """Per class: train papers, positives, and whether the fit beats the best constant.

    Both losses weigh positives as the fit does.
    """
    papers = stored(V.papers(spark, sf).where(F.col("split") == "train"), "papers")
    path = scratch_path(spark, "logreg")
    train_logreg(papers).save(spark, path)
    scored = score_logreg(papers, LogRegModel.load(spark, path), ("y",))
    cells = scored.select(F.posexplode(F.arrays_zip("y", "logit")).alias("idx", "c")).select("idx", "c.*")
    cells = cells.join(F.broadcast(pos_weight(papers).select("idx", "pos_weight")), "idx")
    x, y, w = F.col("logit"), F.col("y"), F.col("pos_weight")
    softplus = lambda v: F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))
    sums = cells.groupBy("idx", label_name(F.col("idx")).alias("label")).agg(
        F.count(F.lit(1)).alias("papers"), F.count_if(y == 1).alias("positives"),
        F.sum(w * y * softplus(-x) + (1 - y) * softplus(x)).alias("loss"), F.max(w).alias("w"))
    heavy, light = F.col("w") * F.col("positives"), F.col("papers") - F.col("positives")
    rate = heavy / (heavy + light)
    constant = -(heavy * F.log(rate) + light * F.log(1 - rate))
    fitted = (F.col("positives") > 0) & (light > 0)
    return sums.select("idx", "label", "papers", "positives", F.when(
        fitted, F.col("loss") < constant).otherwise(F.lit(False)).alias("better"))


@query("train_job", sql(f"""
    SELECT split, {REPORT_COLUMNS} FROM (
        SELECT 'train' AS split, r.* FROM ({report_sql("split = 'train' AND labelled AND", "0.5")}) r
        UNION ALL
        SELECT 'val', r.* FROM ({report_sql("split = 'val' AND labelled AND", "0.5")}) r)"""))
def train_job_query(spark, sf):
    papers = stored(V.papers(spark, sf), "papers")
    _, report = training.train_job(papers, scratch_path(spark, "trained"))
    return rounded(report)


@query("train_log_own", sql("""
    SELECT 'own' AS run, cast(4 AS bigint) AS passes, cast(4 AS bigint) AS evals, true AS loss_falls,
           true AS best_is_recorded, true AS weights_are_kept,
           (SELECT count(*) FROM papers WHERE split = 'val') AS val_papers"""))
def train_log_own(spark, sf):
    """The iterative fit's own log, read back as any log: its rows, its pick, and the weights of the pick."""
    papers = stored(V.papers(spark, sf), "papers")
    out = scratch_path(spark, "passes")
    model, log = training.gradient_job(papers, out, passes=4, tol=0.0)
    path = f"{out}/{training.STATE}"
    best, recorded = curves.best_checkpoint(log), readers.read_recorded_best(spark, path)
    picked = best.join(recorded, "run").select("run", (
        (F.col("best_step") == F.col("best_global_step")) & (F.col("best_f1") == F.col("best_metric"))
    ).alias("best_is_recorded"), "best_f1")
    # The weights of the picked pass give the F1 that its row tells.
    val = papers.where("split = 'val'")
    again = report(confusion(score_logreg(val, model, ("y",)), 0.5)).select(F.col("f1").alias("again"))
    rows = log.groupBy("run").agg(
        F.count("loss").alias("passes"), F.count("eval_f1").alias("evals"),
        (F.max_by("loss", F.when(F.col("loss").isNotNull(), F.col("step")))
         < F.min_by("loss", F.when(F.col("loss").isNotNull(), F.col("step")))).alias("loss_falls"))
    return (
        rows.join(picked, "run").join(F.broadcast(again))
        .join(F.broadcast(val.agg(F.count(F.lit(1)).alias("val_papers"))))
        .select("run", "passes", "evals", "loss_falls", "best_is_recorded",
                (F.abs(F.col("again") - F.col("best_f1")) < 1e-12).alias("weights_are_kept"), "val_papers"))


# ---- pluggable models, over the embeddings table ----

ONE_MATRIX = 4096  # classes that one matrix in each worker holds; more are scored in blocks
MATRIX_CELLS = 1 << 22  # numbers of such a matrix, which the driver sends


def centroids(spark, sf):
    """``(label, dim, x)``: mean vector of each embedding label."""
    rows = V.table(spark, sf, "embeddings").select(
        "label", F.posexplode("embedding").alias("dim", "x"))
    return rows.groupBy("label", "dim").agg(F.avg("x").alias("x"))


def centroid_model(spark, path, labels, width):
    """A model stored by Spark, sent to the workers once; ``make_predict`` for :func:`score_plugged`.

    Columns of the model's matrix are ``labels`` in order.
    """
    rows = spark.read.parquet(path).select("label", "dim", "x").toArrow()
    matrix = np.zeros((width, len(labels)))
    matrix[rows["dim"].to_numpy(), np.searchsorted(labels, rows["label"].to_numpy())] = rows["x"].to_numpy()
    sent = spark.sparkContext.broadcast(matrix)

    def make_predict():
        matrix = sent.value
        # One vector at a time, so that a result cannot depend on its batch.
        return lambda vectors: np.array([np.asarray(v, dtype=np.float64) @ matrix for v in vectors])

    return make_predict


def plugged(spark, sf, batch_size, one_matrix=ONE_MATRIX, **blocks):
    """``(vec_id, idx, logit)`` of every vector and label; one matrix if the labels fit, else blocks."""
    path = scratch_path(spark, "centroids")
    centroids(spark, sf).write.parquet(path)
    vectors = V.table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    model = spark.read.parquet(path)
    few = sorted(r[0] for r in model.select("label").distinct().limit(one_matrix + 1).collect())
    width = model.agg(F.max("dim") + 1).first()[0]
    if not few or len(few) > one_matrix or len(few) * width > MATRIX_CELLS:
        scored = score_blocked(vectors, model, "vec_id", **blocks)
        return scored.select("vec_id", F.col("label").alias("idx"), F.col("score").alias("logit"))
    make_predict = centroid_model(spark, path, few, width)
    scored = score_plugged(vectors, make_predict, [F.col("v")], "vec_id", batch_size, [[width]])
    each = scored.select("vec_id", F.posexplode("logit").alias("place", "logit"))
    names = spark.createDataFrame(list(enumerate(few)), "place int, idx int")
    return each.join(F.broadcast(names), "place").select("vec_id", "idx", "logit")


@query("plug_model", """
    SELECT vec_id, cast(c.label AS integer) AS idx, round(sum(e.x * c.x), 6) AS logit
    FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim
          FROM embeddings) e
    JOIN (SELECT label, dim, avg(cast(x AS double)) AS x FROM (
              SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim
              FROM embeddings) GROUP BY label, dim) c ON c.dim = e.dim
    GROUP BY vec_id, c.label""")
def plug_model(spark, sf):
    return rounded(plugged(spark, sf, 64))


@query("plug_in_blocks", ORACLES["plug_model"])
def plug_in_blocks(spark, sf):
    """The same scores when a matrix holds three classes: blocks of rows, classes and dimensions."""
    return rounded(plugged(spark, sf, 64, one_matrix=0, rows=100, classes=3, dims=20))


@query("batch_invariance", "SELECT count(*) AS vectors, cast(0 AS bigint) AS different "
                           "FROM embeddings")
def batch_invariance(spark, sf):
    small, large = (
        plugged(spark, sf, size).groupBy("vec_id").agg(
            F.map_from_entries(F.collect_list(F.struct("idx", "logit"))).alias(name))
        for size, name in ((7, "a"), (64, "b"))
    )
    apart = F.exists(F.map_keys("a"), lambda i: F.coalesce(
        F.abs(F.element_at("a", i) - F.element_at("b", i)) > 1e-9, F.lit(True)))
    return small.join(large, "vec_id").agg(
        F.count(F.lit(1)).alias("vectors"), F.count_if(apart).alias("different"))


# ---- training curves ----

@query("ema_series", sql("SELECT run, step, round(loss, 6) AS loss, round(ema, 6) AS ema FROM ema"))
def ema_series(spark, sf):
    train = curves.train_rows(V.train_log(spark, sf))
    return rounded(curves.ema_series(train, ["run"], "step", "loss"))


BEST_SQL = """
    SELECT run, step AS best_step, eval_f1 AS best_f1 FROM (
        SELECT *, row_number() OVER (PARTITION BY run ORDER BY eval_f1 DESC, step) AS rn
        FROM train_log WHERE eval_loss IS NOT NULL) WHERE rn = 1"""


@query("best_checkpoint", sql(f"SELECT run, best_step, round(best_f1, 6) AS best_f1 "
                              f"FROM ({BEST_SQL})"))
def best_checkpoint(spark, sf):
    return rounded(curves.best_checkpoint(V.train_log(spark, sf)))


def _series(column: str, name: str | None = None) -> str:
    return (f"SELECT run, '{name or column}' AS series, step, round({column}, 6) AS value "
            f"FROM train_log WHERE {column} IS NOT NULL")


@query("training_curves", sql(" UNION ALL ".join([
    _series("loss", "train_loss"), _series("learning_rate"), _series("eval_loss"),
    _series("eval_f1"), _series("eval_f1_weighted"), _series("eval_precision"),
    _series("eval_recall"),
    "SELECT run, 'train_loss_ema', step, round(ema, 6) FROM ema",
    f"SELECT run, 'best_f1', best_step, round(best_f1, 6) FROM ({BEST_SQL})",
])))
def training_curves(spark, sf):
    return rounded(curves.training_curves(V.train_log(spark, sf)))


# ---- streaming ----

def run_stream(spark, sf):
    """Feed the records through the tagging stream and return its output folder.

    Each task writes what it has, in four files or more of all records; a micro-batch takes half of them.
    """
    model = model_alone(spark, sf)
    source, out, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "progress"))
    quarter = max(1, -(-V.table(spark, sf, "documents").count() // 4))
    V.records(spark, sf).write.option("maxRecordsPerFile", quarter).option("compression", "gzip").json(source)
    parts = sum(path.endswith(".json.gz") for path in files_in(spark, source))
    incoming = stream.read_record_stream(spark, source, S.RECORDS, files_per_batch=max(1, -(-parts // 2)))
    stream.start_tagging(incoming, model, out, checkpoint).awaitTermination()
    return out


@query("stream_tag", sql("""
    SELECT id, title, true_tags, predicted FROM record_tags WHERE reject_reason IS NULL"""))
def stream_tag(spark, sf):
    return stream.read_tagged(spark, run_stream(spark, sf)).select(
        "id", "title", V.text_of("true_tags").alias("true_tags"),
        V.text_of("predicted_tags").alias("predicted"))


@query("stream_rejects", sql("""
    SELECT id, title, abstract, reject_reason FROM (
        SELECT r.id, r.title, r.abstract, s.reject_reason
        FROM records r JOIN shaped s ON s.paper = r.paper) WHERE reject_reason IS NOT NULL"""))
def stream_rejects(spark, sf):
    return stream.read_rejects(spark, run_stream(spark, sf)).select(
        "id", "title", "abstract", "reject_reason")
