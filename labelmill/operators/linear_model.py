"""A class-weighted one-vs-rest linear text classifier trained from counts.

Training is one aggregate over ``(paper, distinct word)`` rows: per word, its
paper count and its paper count within each class. The weight of a word for a
class is the smoothed log ratio of its rate inside and outside the class, and
the bias is the class's log odds plus the log of its positive weight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions.scoring import sigmoid_array
from labelmill.functions.taxonomy import LABELS, label_name
from labelmill.functions.text import paper_words
from labelmill.operators.bits import flag_possible
from labelmill.operators.lookup import ROW_BYTES, split_table
from labelmill.operators.rows import ROW, numbered
from labelmill.session import share_package, stored

SMOOTHING = 1.0
LOGIT_DIGITS = 9
NO_WORD = ""  # one such row per paper carries papers without a known word
MATRIX_BYTES = 64 << 20  # words and weights of a head that is sent as arrays
AT_ONCE = 1 << 17  # words whose weights a task holds at a time


@dataclass
class LinearModel:
    """``weights(token, df, w)`` and ``bias(idx, label, b, pos_weight)``, both DataFrames.

    ``pos_weight`` is the class weight the model was fitted with.
    """

    weights: DataFrame
    bias: DataFrame
    labels: list[str]

    def bias_vector(self) -> Column:
        pairs = F.array_sort(F.collect_list(F.struct("idx", "b")))
        return self.bias.agg(F.transform(pairs, lambda p: p["b"]).alias("b")).scalar()

    def stored(self) -> LinearModel:
        return LinearModel(
            stored(self.weights, "weights"), stored(self.bias, "bias"), self.labels
        )

    def save(self, path: str, mode: str = "overwrite") -> None:
        self.weights.write.mode(mode).parquet(f"{path}/weights")
        self.bias.write.mode(mode).parquet(f"{path}/bias")

    @staticmethod
    def load(spark, path: str, labels: list[str] | None = None) -> LinearModel:
        return LinearModel(
            spark.read.schema("token string, df bigint, w array<double>").parquet(f"{path}/weights"),
            spark.read.schema("idx int, label string, b double, pos_weight double").parquet(f"{path}/bias"),
            LABELS if labels is None else labels,
        )


def class_counts(papers: DataFrame, n_classes: int, y: str = "y") -> DataFrame:
    """One row ``(n, pos)``: papers, and positives per class as an array."""
    positives = [F.coalesce(F.sum(F.get(y, F.lit(i))), F.lit(0.0)) for i in range(n_classes)]
    return papers.agg(F.count(F.lit(1)).alias("n"), F.array(*positives).alias("pos"))


def _weight(n: Column, pos: Column) -> Column:
    return F.sqrt((n - pos) / F.greatest(pos, F.lit(1.0)))


def pos_weight(papers: DataFrame, labels: list[str] | None = None, y: str = "y") -> DataFrame:
    """``(idx, label, pos, pos_weight)`` with weight ``sqrt((N - pos) / max(pos, 1))``."""
    labels = LABELS if labels is None else labels
    counts = class_counts(papers, len(labels), y)
    rows = counts.select("n", F.posexplode("pos").alias("idx", "pos"))
    return rows.select(
        "idx", label_name(F.col("idx"), labels).alias("label"), F.col("pos").cast("bigint"),
        _weight(F.col("n"), F.col("pos")).alias("pos_weight"),
    )


def pos_weight_vector(weights: DataFrame) -> Column:
    """The weights in index order, as a scalar subquery."""
    pairs = F.array_sort(F.collect_list(F.struct("idx", "pos_weight")))
    return weights.agg(F.transform(pairs, lambda p: p["pos_weight"]).alias("w")).scalar()


def pos_weight_summary(weights: DataFrame) -> DataFrame:
    return weights.agg(
        F.min("pos_weight").alias("min_weight"), F.max("pos_weight").alias("max_weight"),
        F.avg("pos_weight").alias("mean_weight"),
    )


def train_linear(
    papers: DataFrame, labels: list[str] | None = None, min_papers: int = 1,
    smoothing: float = SMOOTHING, y: str = "y",
) -> LinearModel:
    """Fit on frames with ``title``, ``abstract`` and a multi-hot ``y``.

    Every word gets a weight; ``min_papers`` leaves out words of fewer papers if asked to.
    """
    labels = LABELS if labels is None else labels
    k, a = len(labels), F.lit(smoothing)
    totals = class_counts(papers, k, y)

    words = papers.select(F.col(y).alias("y"), F.explode(F.array_distinct(paper_words())).alias("token"))
    per_word = (
        words.groupBy("token")
        .agg(
            F.count(F.lit(1)).alias("df"),
            F.array(*[F.sum(F.get("y", F.lit(i))) for i in range(k)]).alias("inside"),
        )
    )
    if min_papers > 1:
        per_word = per_word.where(F.col("df") >= min_papers)
    n, inside = F.col("t.n"), F.col("inside")
    weights = per_word.withColumn("t", totals.select(F.struct("n", "pos")).scalar()).select(
        "token", "df",
        F.zip_with(
            inside, F.col("t.pos"),
            lambda c, p: F.log((c + a) / (p + 2 * a))
            - F.log((F.col("df") - c + a) / (n - p + 2 * a)),
        ).alias("w"),
    )
    each = totals.select("n", F.posexplode("pos").alias("idx", "pos"))
    p, total = F.col("pos"), F.col("n")
    # A class every paper has would get weight 0; its logarithm is left out.
    weight = _weight(total, p)
    shift = F.when(weight > 0, F.log(weight)).otherwise(0.0)
    bias = each.select(
        "idx", label_name(F.col("idx"), labels).alias("label"),
        (F.log((p + a) / (total - p + a)) + shift).alias("b"), weight.alias("pos_weight"),
    )
    return LinearModel(weights, bias, labels)


WeightParts = tuple[DataFrame | Broadcast, DataFrame | None]


def weight_parts(model: LinearModel, head_rows: int | None = None) -> WeightParts:
    """The model's weights, measured in one job: all of them and None, or a head of bounded size and the rest.

    A head beside a rest is sent to the workers as words and a matrix. The rarer the words of the
    rest are, the fewer of them a paper has.
    """
    k = len(model.labels)
    table = model.weights.select("token", "df", "w")
    packed = (MATRIX_BYTES, 8 * k + 4)
    head, tail = split_table(table, "token", "df", ROW_BYTES + 8 * k, head_rows, packed)
    if tail is None:
        return head, None
    whole = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.get("w", i).cast("double"), F.lit(0.0)))
    found = head.where("token IS NOT NULL AND w IS NOT NULL").select("token", whole.alias("w")).toArrow()
    weights = found["w"].combine_chunks().flatten().to_numpy().reshape(-1, k)
    return model.weights.sparkSession.sparkContext.broadcast((found["token"].combine_chunks(), weights)), tail


def _met(head: Broadcast, k: int) -> Callable:
    """``(known, sums, rest)`` of a paper's words: how many the head knows, their weights, the other words."""

    @F.arrow_udf("struct<known: bigint, sums: array<double>, rest: array<string>>")
    def met(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import pyarrow.compute as pc

        tokens, weights = head.value
        for papers in batches:
            at, n = papers.offsets.to_numpy().astype(np.int64), len(papers)
            words = papers.values.slice(at[0], at[-1] - at[0])
            at -= at[0]
            place = pc.index_in(words, value_set=tokens).fill_null(-1).to_numpy()
            sums, known = np.zeros((n, k)), np.zeros(n, np.int64)
            start = 0
            while start < n:
                end = max(start + 1, int(np.searchsorted(at, at[start] + AT_ONCE, "right")) - 1)
                idx = place[at[start] : at[end]]
                row = np.repeat(np.arange(start, end), np.diff(at[start : end + 1]))[idx >= 0]
                known[start:end] = np.bincount(row - start, minlength=end - start)
                if len(row):
                    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    sums[row[first]] = np.add.reduceat(weights[idx[idx >= 0]], first, axis=0)
                start = end
            left = np.r_[0, np.cumsum(place < 0)][at].astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(left), words.filter(pa.array(place < 0)).cast(pa.string()))
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(sums.ravel()))
            yield pa.StructArray.from_arrays([pa.array(known), vectors, rest], ["known", "sums", "rest"])

    return met


def score_linear(
    papers: DataFrame, model: LinearModel, key: str | None = None, keep: tuple[str, ...] = ("id",),
    head_rows: int | None = None, parts: WeightParts | None = None,
) -> DataFrame:
    """``(*keep, logit, prob)`` for every row of ``papers``; ids may repeat.

    logit = bias + (sum of the weights of the paper's known words) / sqrt(their number).
    The text is split once. A paper's words meet the broadcast head inside the task that read it,
    so the sums combine there and one short row per paper is shuffled. Of a larger model, the rows
    are written once with the sums of the head and the words beyond it, which takes no shuffle and
    no sort; only those words meet the tail, in as many tasks as run at a time: each sums up what it
    finds of a paper, so that a paper's sums are no more rows than that. ``key`` names a column that is unique already, which
    spares numbering the rows first. ``parts`` are the model's weights as :func:`weight_parts` has
    split them, for callers that score many times.
    """
    k = len(model.labels)
    head, tail = parts or weight_parts(model, head_rows)
    if tail is not None:
        return _scored(*_beyond_head(papers, head, tail, k, key, keep), model, keep)
    if key is None:
        papers, key = numbered(papers.select(*dict.fromkeys(["title", "abstract", *keep]))), ROW
    marked = F.concat(F.array(F.lit(NO_WORD)), F.array_distinct(paper_words()))
    tokens = papers.select(F.col(key).alias(ROW), F.explode(marked).alias("token"))
    hit = F.when(F.col("w").isNotNull(), 1).otherwise(0)
    total = tokens.join(F.broadcast(head), "token", "left").groupBy(ROW).agg(
        F.coalesce(F.sum(hit), F.lit(0)).alias("known"), *_sums(k))
    total = total.select(ROW, "known", F.array(*[F.col(f"s{i}") for i in range(k)]).alias("sums"))
    scored = _scored(total, F.col("known"), F.col("sums"), model, (ROW,))
    if list(keep) == [key]:
        return scored.withColumnRenamed(ROW, key)
    kept = papers.select(F.col(key).alias("__key"), *keep).withColumnRenamed("__key", ROW)
    return kept.join(scored, ROW).drop(ROW)


def _sums(k: int) -> list[Column]:
    return [F.coalesce(F.sum(F.get("w", F.lit(i))), F.lit(0.0)).alias(f"s{i}") for i in range(k)]


def _scored(rows: DataFrame, known: Column, sums: Column, model: LinearModel, keep: tuple[str, ...]) -> DataFrame:
    scale = F.greatest(F.sqrt(known), F.lit(1.0))
    ready = rows.select(*keep, F.transform(sums, lambda s: s / scale).alias("__total")).withColumn("__bias", model.bias_vector())
    # Rounding absorbs the order in which the weights were added, so equal texts score equal.
    logit = F.zip_with("__total", "__bias", lambda s, b: F.round(s + b, LOGIT_DIGITS))
    return ready.select(*keep, logit.alias("logit")).withColumn("prob", sigmoid_array(F.col("logit")))


def _beyond_head(
    papers: DataFrame, head: Broadcast, tail: DataFrame, k: int, key: str | None, keep: tuple[str, ...]
) -> tuple[DataFrame, Column, Column]:
    """``papers`` with what they kept, the number of known words, and the sums of their weights."""
    share_package(papers.sparkSession)
    line = F.monotonically_increasing_id() if key is None else F.col(key)
    met = papers.select(*keep, line.alias("__line"), _met(head, k)(F.array_distinct(paper_words())).alias("__met"))
    part = [F.col(f"__met.{x}").alias(f"__{x}") for x in ("known", "sums", "rest")]
    rows = stored(met.select(*keep, "__line", *part), "head-sums")
    rest = flag_possible(rows.select("__line", F.explode("__rest").alias("token")), tail, "token", "__possible")
    found = rest.where("__possible").drop("__possible").join(tail.where("w IS NOT NULL"), "token")
    # A paper's words are summed in the task that has met them, and each such task costs it a row of sums:
    # no more tasks than run at a time, however many partitions the join has.
    found = found.coalesce(max(1, papers.sparkSession.sparkContext.defaultParallelism))
    late = found.groupBy("__line").agg(F.count(F.lit(1)).alias("known"), *_sums(k))
    late = late.select("__line", F.col("known").alias("__late"), F.array(*[F.col(f"s{i}") for i in range(k)]).alias("__more"))
    both = rows.drop("__rest").join(late, "__line", "left")
    sums = F.when(F.col("__more").isNull(), F.col("__sums")).otherwise(F.zip_with("__sums", "__more", lambda a, b: a + b))
    return both, F.col("__known") + F.coalesce("__late", F.lit(0)), sums
