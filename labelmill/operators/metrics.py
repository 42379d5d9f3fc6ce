"""Multi-label metrics over scored papers.

A scored frame holds one row per paper with dense vectors ``y`` and ``prob``
over the class list. Counting sums over array places, so each task sends one row
to the shuffle whatever the number of papers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions.scoring import predict, threshold_vector
from labelmill.functions.taxonomy import LABELS, label_array, label_name


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, 0.0).otherwise(num / den)


def _counts(df: DataFrame, pred: Column, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, idx, tp, fp, fn, support, hits, papers)``: sums over array places, one row per paper."""
    paper = df.select(*by, F.col("y"), pred.alias("p"))
    hit = F.exists(F.zip_with("y", "p", lambda y, p: (y == 1) & p), lambda x: x)

    def cell(i: int) -> Column:
        y, p = F.get("y", F.lit(i)) == 1, F.get("p", F.lit(i))
        return F.struct(
            F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
            F.count_if(y & ~p).alias("fn"), F.count_if(y).alias("support"),
        )

    sums = paper.withColumn("hit", hit).groupBy(*by).agg(
        F.array(*[cell(i) for i in range(n)]).alias("cells"),
        F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("papers"),
    )
    return sums.where("papers > 0").select(*by, F.posexplode("cells").alias("idx", "c"), "hits", "papers").select(
        *by, "idx", "c.*", "hits", "papers"
    )


def confusion(
    scored: DataFrame, thresholds=None, labels: list[str] | None = None, inclusive: bool = False
) -> DataFrame:
    """``(idx, label, tp, fp, fn, support, hits, papers)`` per class, in one pass.

    ``hits`` and ``papers`` repeat on every class: papers with a correct tag, and all papers.
    """
    ready = scored.withColumn("t", threshold_vector(thresholds, labels))
    n = len(LABELS if labels is None else labels)
    counts = _counts(ready, predict(F.col("prob"), F.col("t"), inclusive), n)
    return counts.withColumn("label", label_name(F.col("idx"), labels))


def prf_per_class(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class; a zero denominator gives 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    })


def _macro() -> list[Column]:
    return [F.avg(m).alias(m) for m in ("precision", "recall", "f1")]


def _weighted_f1() -> Column:
    return _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support"))


def prf_macro(counts: DataFrame) -> DataFrame:
    """Unweighted means over classes; F1 is the mean of class F1s."""
    return prf_per_class(counts).agg(*_macro())


def prf_weighted(counts: DataFrame) -> DataFrame:
    per_class = prf_per_class(counts)
    weighted = [
        _ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"{m}_weighted")
        for m in ("precision", "recall", "f1")
    ]
    return per_class.agg(*weighted)


def prf_micro(counts: DataFrame) -> DataFrame:
    """Ratios of the summed counts."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return counts.agg(
        _ratio(tp, tp + fp).alias("precision_micro"),
        _ratio(tp, tp + fn).alias("recall_micro"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_micro"),
    )


def hit_rate(counts: DataFrame) -> DataFrame:
    """Share of all papers, unlabelled ones included, with at least one correct tag."""
    return counts.agg(_ratio(F.max("hits"), F.max("papers")).alias("hit_rate"))


def report(counts: DataFrame) -> DataFrame:
    """The one-row metric report of an evaluation run."""
    return prf_per_class(counts).agg(
        F.avg("f1").alias("f1"),
        _weighted_f1().alias("f1_weighted"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        _ratio(F.max("hits"), F.max("papers")).alias("hit_rate"),
    )


def compare_thresholds(
    scored: DataFrame, policies: dict[str, object], labels: list[str] | None = None
) -> DataFrame:
    """Macro and weighted F1 of several threshold policies, scored in one pass."""
    vectors = {f"t{i}": threshold_vector(t, labels) for i, t in enumerate(policies.values())}
    variants = F.array(*[
        F.struct(F.lit(name).alias("policy"), predict(F.col("prob"), F.col(t)).alias("pred"))
        for name, t in zip(policies, vectors)
    ])
    each = scored.withColumns(vectors).select("y", F.explode(variants).alias("v")).select(
        "y", F.col("v.policy").alias("policy"), F.col("v.pred").alias("pred")
    )
    counts = _counts(each, F.col("pred"), len(LABELS if labels is None else labels), ("policy",))
    return prf_per_class(counts).groupBy("policy").agg(
        F.avg("f1").alias("f1_macro"), _weighted_f1().alias("f1_weighted")
    )


def tag_sums(labels: list[str] | None = None) -> list[Column]:
    """Sums behind the quick metrics, over rows with ``true_tags`` and ``predicted_tags``."""
    known, judged = label_array(labels), F.col("true_tags").isNotNull()
    t, p = F.array_intersect("true_tags", known), F.array_intersect("predicted_tags", known)
    both = F.size(F.array_intersect(t, p))
    sums = {"tp": both, "fp": F.size(p) - both, "fn": F.size(t) - both}
    hit = judged & F.arrays_overlap("true_tags", "predicted_tags")
    return [
        *[F.sum(F.when(judged, x)).alias(n) for n, x in sums.items()],
        F.count_if(hit).alias("hits"), F.count_if(judged).alias("papers"),
    ]


def tag_ratios(sums: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(
        "papers",
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_micro"),
        _ratio(tp, tp + fp).alias("precision_micro"),
        _ratio(tp, tp + fn).alias("recall_micro"),
        _ratio(F.col("hits"), F.col("papers")).alias("hit_rate"),
    )


def tag_metrics(tagged: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Quick metrics of tagged papers: micro P/R/F1, hit rate, and the papers they cover.

    Only rows whose ``true_tags`` is not null count. Tags outside the class list
    are ignored by P/R/F1 but a shared one still makes a hit.
    """
    return tag_ratios(tagged.agg(*tag_sums(labels)))


def tag_intersection(predicted: Column, true: Column) -> Column:
    return F.array_intersect(predicted, true)


def tag_errors(predicted: Column, true: Column) -> tuple[Column, Column]:
    """False positive and false negative label sets."""
    return F.array_except(predicted, true), F.array_except(true, predicted)


def weighted_bce(scored: DataFrame, pos_weight: Column) -> DataFrame:
    """Mean class-weighted binary cross-entropy over every (paper, class) cell.

    ``pos_weight`` is one weight per class; softplus is written so that large
    logits neither overflow nor lose the small term.
    """
    cell = F.arrays_zip("y", "logit", pos_weight.alias("w"))

    def softplus(v: Column) -> Column:
        return F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))

    def loss(c: Column) -> Column:
        return c["w"] * c["y"] * softplus(-c["logit"]) + (1 - c["y"]) * softplus(c["logit"])

    rows = scored.select(cell.alias("cell"))
    own = F.aggregate("cell", F.lit(0.0), lambda a, c: a + loss(c))
    return rows.agg((F.sum(own) / F.sum(F.size("cell"))).alias("loss"))
