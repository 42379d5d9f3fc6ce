"""Sample, fit, evaluate and save in one job."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from labelmill import schemas as S
from labelmill.functions.taxonomy import LABELS
from labelmill.operators import logreg
from labelmill.operators.curves import best_checkpoint
from labelmill.operators.linear_model import LinearModel, pos_weight, train_linear
from labelmill.operators.logreg import LogRegModel, Step, score_logreg, train_logreg
from labelmill.operators.metrics import confusion, report, weighted_bce
from labelmill.operators.sampling import sample_train_val
from labelmill.plans.evaluation import evaluate
from labelmill.session import stored
from labelmill.sources.files import path_exists, read_text
from labelmill.sources.readers import read_recorded_best, read_train_log
from labelmill.sources.writers import write_document, write_report


def train_job(
    papers: DataFrame, out: str, ratio: float = 1.0, seed: int = 42, labels: list[str] | None = None,
    smoothing: float = 1.0, threshold: float = 0.5, key: str | None = None,
) -> tuple[LinearModel, DataFrame]:
    """Fit on a sample of the train split and report on a sample of the val split.

    Val is drawn with the next seed. Class weights come from the sampled train papers and stay
    with the model. ``key`` names a column that is unique already, if there is one. ``out`` gets
    ``model``, ``settings`` and ``report``. Returns the saved model
    and a report row for ``train`` and one for ``val``.
    """
    spark = papers.sparkSession
    train, val = sample_train_val(papers, ratio, seed)
    train, val = stored(train, "train-sample"), stored(val, "val-sample")
    train_linear(train, labels, smoothing=smoothing).save(f"{out}/model")
    model = LinearModel.load(spark, f"{out}/model", labels)
    sides = [
        evaluate(rows, model, threshold, name, key=key).withColumn("split", F.lit(name))
        for name, rows in (("train", train), ("val", val))
    ]
    report = stored(sides[0].unionByName(sides[1]), "train-report")
    write_report(report, f"{out}/report")
    settings = {"ratio": ratio, "seed": seed, "smoothing": smoothing, "threshold": threshold}
    write_report(spark.range(1).select(*[F.lit(v).alias(k) for k, v in settings.items()]), f"{out}/settings")
    return model, report


# --- the iterative fit, with a log of its passes ---------------------------------------------

STATE = "state.json"


def gradient_job(
    papers: DataFrame, out: str, run: str = "own", passes: int = 20, every: int = 1, ratio: float = 1.0, seed: int = 42,
    labels: list[str] | None = None, features: int = logreg.FEATURES, reg: float = 1e-3, tol: float = 1e-4,
    threshold: float = 0.5,
) -> tuple[LogRegModel, DataFrame]:
    """Fit all classes by gradient, keep every pass, and give the pass with the best val F1.

    A pass is one read of the sampled train papers. After every ``every``-th one, and the last, ``out``
    gets ``checkpoint-<pass>`` with the weights, and with the log so far: a row of the mean train
    loss and step length, and a row of the val papers' loss, F1, weighted F1, precision and recall.
    ``state.json`` of the last checkpoint is the run's log, which :func:`read_train_log` reads; it
    names the best pass (the earliest on ties). Returns the model of that pass, read back from its
    checkpoint, and the log.
    """
    spark = papers.sparkSession
    labels = LABELS if labels is None else labels
    train, val = sample_train_val(papers, ratio, seed)
    train, val = stored(train, "train-sample"), stored(val, "val-sample")
    weights = {r["idx"]: r["pos_weight"] for r in pos_weight(train, labels).collect()}
    vector = F.array(*[F.lit(float(weights.get(i, 1.0))) for i in range(len(labels))])
    history: list[Row] = []
    steps: list[Step] = []

    def checkpoint(step: Step) -> None:
        folder = f"{out}/checkpoint-{step.number}"
        model = step.model()
        model.save(spark, f"{folder}/weights")
        fitted = [i for i, own in enumerate(model.fitted) if own]
        history.append(_entry(
            step=step.number, loss=_mean(step.loss[fitted]), learning_rate=_mean(step.length[fitted]),
        ))
        history.append(_entry(step=step.number, **val_metrics(val, model, vector, threshold)))
        best = max((h for h in history if h.eval_f1 is not None), key=lambda h: (h.eval_f1, -h.step))
        state = {
            "run": run, "log_history": [h.asDict() for h in history], "best_global_step": best.step, "best_metric": best.eval_f1,
        }
        write_document(spark, json.dumps(state), f"{folder}/{STATE}")

    def on_step(step: Step) -> None:
        steps[:] = [step]  # a step holds a model; only the last is needed
        if step.number > 0 and step.number % every == 0:
            checkpoint(step)

    model = train_logreg(train, labels, features, passes, tol, reg, on_step=on_step)
    if steps and (steps[-1].number == 0 or steps[-1].number % every):
        checkpoint(steps[-1])
    if not steps:  # no class has both outcomes: nothing to fit
        checkpoint(Step(0, np.zeros(len(labels)), np.zeros(len(labels)), np.zeros(len(labels), bool), lambda: model))
    last = f"{out}/checkpoint-{history[-1].step}/{STATE}"
    write_document(spark, read_text(spark, last), f"{out}/{STATE}")
    return load_best(spark, out, labels), read_train_log(spark, f"{out}/{STATE}")


def val_metrics(val: DataFrame, model: LogRegModel, pos_weights, threshold: float = 0.5) -> dict[str, float]:
    """The evaluation part of a log row, in one pass over the val papers for all metrics but the loss."""
    scored = stored(score_logreg(val, model, ("y",)), "val-scores")
    found = report(confusion(scored, threshold, model.labels)).first()
    names = {"f1": "eval_f1", "f1_weighted": "eval_f1_weighted", "precision": "eval_precision", "recall": "eval_recall"}
    told = {to: (0.0 if found[name] is None else found[name]) for name, to in names.items()}
    loss = weighted_bce(scored, pos_weights).first()["loss"]
    return {"eval_loss": 0.0 if loss is None else loss, **told}


def load_best(spark: SparkSession, out: str, labels: list[str] | None = None) -> LogRegModel:
    """The model of the best pass that the log of ``out`` names.

    The log is searched as any other is, and must agree with the pass it recorded itself.
    """
    path = f"{out}/{STATE}"
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    best = best_checkpoint(read_train_log(spark, path)).first()
    recorded = read_recorded_best(spark, path).first()
    if best is None or best["best_step"] != recorded["best_global_step"]:
        raise ValueError(f"{path} names pass {recorded['best_global_step']} as the best, its rows do not")
    return LogRegModel.load(spark, f"{out}/checkpoint-{best['best_step']}/weights", labels)


def _mean(of_classes: np.ndarray) -> float:
    return float(of_classes.mean()) if len(of_classes) else 0.0


def _entry(**known) -> Row:
    return Row(**{name: known.get(name) for name in S.LOG_ENTRY.names})
