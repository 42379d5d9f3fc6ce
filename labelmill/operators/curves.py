"""Training-log tables: log split, smoothed loss, best checkpoint, tidy curves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.operators.bits import flag_possible

CHUNK = 512


def train_rows(log: DataFrame) -> DataFrame:
    return log.where(F.col("loss").isNotNull() & F.col("eval_loss").isNull())


def eval_rows(log: DataFrame) -> DataFrame:
    return log.where(F.col("eval_loss").isNotNull())


Step = Callable[[Column], tuple[Column, Column]]  # ``m`` and ``b`` of an item


def _fold(items: Column, start: Column, step: Step) -> Column:
    """Running carries: the value that enters each step of ``E = m*E + b``."""
    seed = F.struct(start.alias("e"), F.array().cast("array<double>").alias("seen"))

    def after(e: Column, item: Column) -> Column:
        m, b = step(item)
        return m * e + b

    done = F.aggregate(
        items, seed,
        lambda acc, s: F.struct(
            after(acc["e"], s).alias("e"), F.concat(acc["seen"], F.array(acc["e"])).alias("seen"),
        ),
    )
    return done["seen"]


def _carries(steps: DataFrame, keys: list[str], span: int, chunk: int, columns: list[str], step: Step) -> DataFrame:
    """Add ``carry``, the running value before each step, to ``(*keys, *columns)``.

    ``columns`` are ``pos``, ``x0`` and what ``step`` reads of an item. A series has at most ``chunk``
    steps, or its ``pos`` is unique and lies within ``span`` values. Steps are grouped
    into chunks of positions, each chunk is reduced to a single equivalent step, the
    chunks' own carries come from the same procedure one level up, and every chunk is
    then unrolled from its carry. No task holds more than ``chunk`` steps of a series
    at a time.
    """
    item = F.struct(*columns)
    if span <= chunk:
        series = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
        opened = series.withColumn("carry", F.get("items", F.lit(0))["x0"])
        owner = keys
    else:
        owner = [*keys, "chunk"]
        chunks = (
            steps.withColumn("chunk", F.floor(F.col("pos") / chunk))
            .groupBy(*owner).agg(F.array_sort(F.collect_list(item)).alias("items"))
        )
        m = F.aggregate("items", F.lit(1.0), lambda acc, s: acc * step(s)[0])
        b = F.aggregate("items", F.lit(0.0), lambda acc, s: acc * step(s)[0] + step(s)[1])
        summary = chunks.select(
            *keys, F.col("chunk").alias("pos"), m.alias("m"), b.alias("b"),
            F.get("items", F.lit(0))["x0"].alias("x0"),
        )
        above = _carries(
            summary, keys, -(-span // chunk) + 1, chunk, ["pos", "m", "b", "x0"], lambda s: (s["m"], s["b"])
        )
        opened = chunks.join(
            above.select(*keys, F.col("pos").alias("chunk"), "carry"), owner
        )
    unrolled = F.arrays_zip("items", _fold(F.col("items"), F.col("carry"), step).alias("carry"))
    rows = opened.select(*owner, F.explode(unrolled).alias("r"))
    return rows.select(*keys, *[F.col(f"r.items.{c}").alias(c) for c in columns], F.col("r.carry").alias("carry"))


def ema_series(
    df: DataFrame, keys: list[str], pos: str, value: str, alpha: float = 0.05, chunk: int = CHUNK
) -> DataFrame:
    """``(*keys, pos, value, ema)``: exponential moving average along each series.

    The first value seeds the average. ``pos`` is a whole number, unique within its
    series. Series of any length are split over tasks; one of at most ``chunk`` steps is
    folded whole, however far apart they lie. Steps without a position come
    first. Where positions span more than ``chunk``, rows without a key or position are not returned.
    """
    steps = df.select(*keys, F.col(pos).cast("bigint").alias("pos"), F.col(value).cast("double").alias("x0"))

    def step(item: Column) -> tuple[Column, Column]:
        return F.lit(1.0 - alpha), item["x0"] * alpha

    def carried(some: DataFrame, span: int) -> DataFrame:
        return _carries(some, keys, span, chunk, ["pos", "x0"], step)

    sizes = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi")
    )
    ends = sizes.agg(F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    span = 1 if ends["hi"] is None else ends["hi"] - ends["lo"] + 1
    if span <= chunk:
        rows = carried(steps, span)
    else:
        for key in keys:
            steps = steps.where(F.col(key).isNotNull())
        if ends["n"] <= chunk:
            rows = carried(steps, 1)
        else:
            # The long series are told by a bit table of fixed size; a short one that it takes for long is chunked too.
            series = F.xxhash64(*keys).alias("__series")
            long = sizes.where(F.col("n") > chunk).select(series)
            told = flag_possible(steps.select("*", series), long, "__series", "__long").drop("__series")
            rows = carried(told.where("NOT __long"), 1).unionByName(carried(told.where("__long"), span))
        rows = rows.where("pos IS NOT NULL")
    ema = (1.0 - alpha) * F.col("carry") + F.col("x0") * alpha
    return rows.select(*keys, F.col("pos").alias(pos), F.col("x0").alias(value), ema.alias("ema"))


def best_checkpoint(log: DataFrame, by: str = "run") -> DataFrame:
    """Step of the highest eval F1 per run, the earliest on ties."""
    best = F.max_by(F.struct("step", "eval_f1"), F.struct("eval_f1", -F.col("step")))
    return (
        eval_rows(log).groupBy(by).agg(best.alias("b"))
        .select(by, F.col("b.step").alias("best_step"), F.col("b.eval_f1").alias("best_f1"))
    )


def training_curves(log: DataFrame, alpha: float = 0.05, by: str = "run") -> DataFrame:
    """Tidy ``(run, series, step, value)`` rows behind the training plots."""
    train, evals = train_rows(log), eval_rows(log)
    smooth = ema_series(train, [by], "step", "loss", alpha).select(
        by, F.lit("train_loss_ema").alias("series"), "step", F.col("ema").alias("value")
    )

    def tidy(df: DataFrame, columns: dict[str, str]) -> DataFrame:
        named = [F.col(c).cast("double").alias(n) for c, n in columns.items()]
        wide = df.select(by, "step", *named)
        long = wide.unpivot([by, "step"], list(columns.values()), "series", "value")
        return long.where(F.col("value").isNotNull()).select(by, "series", "step", "value")

    metrics = ["eval_loss", "eval_f1", "eval_f1_weighted", "eval_precision", "eval_recall"]
    best = best_checkpoint(log, by).select(
        by, F.lit("best_f1").alias("series"), F.col("best_step").alias("step"),
        F.col("best_f1").alias("value"),
    )
    return (
        tidy(train, {"loss": "train_loss", "learning_rate": "learning_rate"})
        .unionByName(smooth).unionByName(tidy(evals, {m: m for m in metrics})).unionByName(best)
    )
