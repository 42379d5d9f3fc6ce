"""Metrics, threshold sweeps, class weights and loss over the scored catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.functions.taxonomy import LABELS, label_dim
from labelmill.operators import metrics as M
from labelmill.operators import tuning
from labelmill.operators.linear_model import pos_weight, pos_weight_summary, pos_weight_vector
from labelmill.plans.tagging import add_tags
from labelmill.registry import views as V
from labelmill.registry.base import query
from labelmill.registry.sql_views import sql


def rounded(df, digits=6):
    """Derived doubles cut to a precision both engines reach."""
    return df.select(*[
        F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])


def counts(spark, sf):
    return M.confusion(V.scored(spark, sf), 0.5)


@query("confusion_per_class", sql("SELECT idx, label, tp, fp, fn, support FROM counts"))
def confusion_per_class(spark, sf):
    return counts(spark, sf).select("idx", "label", "tp", "fp", "fn", "support")


@query("prf_per_class", sql("""
    SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall,
           round(f1, 6) AS f1, support FROM prf"""))
def prf_per_class(spark, sf):
    out = M.prf_per_class(counts(spark, sf))
    return rounded(out.select("label", "precision", "recall", "f1", "support"))


@query("prf_macro", sql("""
    SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
           round(avg(f1), 6) AS f1 FROM prf"""))
def prf_macro(spark, sf):
    return rounded(M.prf_macro(counts(spark, sf)))


@query("prf_weighted", sql("""
    SELECT round(sum(precision * support) / sum(support), 6) AS precision_weighted,
           round(sum(recall * support) / sum(support), 6) AS recall_weighted,
           round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM prf"""))
def prf_weighted(spark, sf):
    return rounded(M.prf_weighted(counts(spark, sf)))


@query("prf_micro", sql("""
    SELECT round(sum(tp) / (sum(tp) + sum(fp)), 6) AS precision_micro,
           round(sum(tp) / (sum(tp) + sum(fn)), 6) AS recall_micro,
           round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1_micro FROM counts"""))
def prf_micro(spark, sf):
    return rounded(M.prf_micro(counts(spark, sf)))


@query("hit_rate", sql("""
    SELECT round(avg(hit), 6) AS hit_rate FROM (
        SELECT id, max(case when y = 1 AND prob > cast(0.5 AS double) then 1 else 0 end) AS hit
        FROM cells GROUP BY id)"""))
def hit_rate(spark, sf):
    return rounded(M.hit_rate(counts(spark, sf)))


@query("metric_report", sql("""
    SELECT round(avg(f1), 6) AS f1, round(sum(f1 * support) / sum(support), 6) AS f1_weighted,
           round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
           (SELECT round(avg(hit), 6) FROM (
               SELECT id, max(case when y = 1 AND prob > cast(0.5 AS double) then 1 else 0 end)
                      AS hit FROM cells GROUP BY id)) AS hit_rate
    FROM prf"""))
def metric_report(spark, sf):
    return rounded(M.report(counts(spark, sf)))


@query("hit_semi", sql("SELECT id FROM tagged WHERE n_right > 0"))
def hit_semi(spark, sf):
    tags = add_tags(V.scored(spark, sf), V.label_thresholds(spark, sf))
    return tags.where(F.arrays_overlap("predicted_tags", "labels")).select("id")


@query("tag_intersection", sql("""
    SELECT id, coalesce(string_agg(label, '|' ORDER BY idx) FILTER (p AND y = 1), '') AS shared
    FROM tags GROUP BY id"""))
def tag_intersection(spark, sf):
    tags = add_tags(V.scored(spark, sf), V.label_thresholds(spark, sf))
    shared = M.tag_intersection(F.col("predicted_tags"), F.col("labels"))
    return tags.select("id", V.text_of(shared).alias("shared"))


@query("tag_errors", sql("""
    SELECT id, coalesce(string_agg(label, '|' ORDER BY idx) FILTER (p AND y = 0), '') AS wrong,
           coalesce(string_agg(label, '|' ORDER BY idx) FILTER (NOT p AND y = 1), '') AS missed
    FROM tags GROUP BY id"""))
def tag_errors(spark, sf):
    tags = add_tags(V.scored(spark, sf), V.label_thresholds(spark, sf))
    wrong, missed = M.tag_errors(F.col("predicted_tags"), F.col("labels"))
    return tags.select("id", V.text_of(wrong).alias("wrong"), V.text_of(missed).alias("missed"))


@query("tag_metrics", sql("""
    SELECT count(*) AS papers,
           round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1_micro,
           round(sum(tp) / (sum(tp) + sum(fp)), 6) AS precision_micro,
           round(sum(tp) / (sum(tp) + sum(fn)), 6) AS recall_micro,
           round(avg(case when tp > 0 then 1 else 0 end), 6) AS hit_rate
    FROM (SELECT id, count(*) FILTER (p AND y = 1) AS tp, count(*) FILTER (p AND y = 0) AS fp,
                 count(*) FILTER (NOT p AND y = 1) AS fn, sum(y) AS positives
          FROM tags GROUP BY id) WHERE positives > 0"""))
def tag_metrics(spark, sf):
    tags = add_tags(V.scored(spark, sf), V.label_thresholds(spark, sf))
    true = F.when(F.size("labels") > 0, F.col("labels"))
    return rounded(M.tag_metrics(tags.withColumn("true_tags", true)))


@query("join_thresholds", sql("""
    SELECT idx, label, threshold, count(*) FILTER (p) AS above FROM tags
    GROUP BY idx, label, threshold"""))
def join_thresholds(spark, sf):
    """Index to name, name to threshold with the default for absent ones, scores above it."""
    found = label_dim(spark).join(V.label_thresholds(spark, sf), "label", "left")
    dim = found.select("idx", "label", F.coalesce("threshold", F.lit(0.5)).alias("threshold"))
    cells = V.scored(spark, sf).select(F.posexplode("prob").alias("idx", "prob"))
    return cells.join(F.broadcast(dim), "idx").groupBy("idx", "label", "threshold").agg(
        F.count_if(F.col("prob") > F.col("threshold")).alias("above"))


POLICY_SQL = """
    SELECT policy, round(avg(f1), 6) AS f1_macro,
           round(sum(f1 * support) / sum(support), 6) AS f1_weighted
    FROM (SELECT policy, idx, count(*) FILTER (y = 1) AS support,
                 case when 2 * count(*) FILTER (y = 1 AND p) + count(*) FILTER (y = 0 AND p)
                           + count(*) FILTER (y = 1 AND NOT p) = 0 then 0
                      else 2 * count(*) FILTER (y = 1 AND p)
                           / (2 * count(*) FILTER (y = 1 AND p) + count(*) FILTER (y = 0 AND p)
                              + count(*) FILTER (y = 1 AND NOT p)) end AS f1
          FROM ({source}) GROUP BY policy, idx) GROUP BY policy"""


@query("compare_thresholds", sql(POLICY_SQL.format(source="""
    SELECT 'scalar' AS policy, idx, y, prob > cast(0.35 AS double) AS p FROM cells
    UNION ALL SELECT 'per_class', idx, y, p FROM tags""")))
def compare_thresholds(spark, sf):
    policies = {"scalar": 0.35, "per_class": V.label_thresholds(spark, sf)}
    return rounded(M.compare_thresholds(V.scored(spark, sf), policies))


CURVE_SQL = """
    SELECT idx, label, prob, tp, predicted, precision, recall,
           2 * precision * recall / (precision + recall + cast(1e-8 AS double)) AS f1
    FROM (SELECT idx, label, prob, cast(ctp AS bigint) AS tp, cast(cn AS bigint) AS predicted,
                 ctp / cn AS precision, case when pos = 0 then 1 else ctp / pos end AS recall
          FROM (SELECT *, sum(tp) OVER (PARTITION BY idx ORDER BY prob DESC) AS ctp,
                       sum(n) OVER (PARTITION BY idx ORDER BY prob DESC) AS cn,
                       sum(tp) OVER (PARTITION BY idx) AS pos
                FROM (SELECT idx, any_value(label) AS label, prob, sum(y) AS tp, count(*) AS n
                      FROM cells GROUP BY idx, prob)))"""


@query("pr_curve", sql(f"""
    SELECT idx, label, prob, tp, predicted, precision, recall, f1 FROM ({CURVE_SQL})"""))
def pr_curve(spark, sf):
    # Small bins, so that the two-level sums are exercised at every table size.
    return tuning.pr_curve(V.scored(spark, sf), rows_per_bin=500)


@query("tune_thresholds", sql(f"""
    SELECT idx, label, round(prob, 4) AS threshold, round(f1, 4) AS f1,
           round(precision, 4) AS precision, round(recall, 4) AS recall
    FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY f1 DESC, prob) AS rn
          FROM ({CURVE_SQL})) WHERE rn = 1"""))
def tune_thresholds(spark, sf):
    return tuning.tune(V.scored(spark, sf), LABELS)


CLASS_SQL = """
    SELECT idx, label, cast(sum(y) AS bigint) AS pos,
           sqrt((count(*) - sum(y)) / greatest(sum(y), 1)) AS pos_weight
    FROM cells GROUP BY idx, label"""


@query("pos_weight", sql(f"""
    SELECT idx, label, pos, round(pos_weight, 6) AS pos_weight FROM ({CLASS_SQL})"""))
def pos_weight_query(spark, sf):
    return rounded(pos_weight(V.scored(spark, sf)))


@query("pos_weight_summary", sql(f"""
    SELECT round(min(pos_weight), 6) AS min_weight, round(max(pos_weight), 6) AS max_weight,
           round(avg(pos_weight), 6) AS mean_weight FROM ({CLASS_SQL})"""))
def pos_weight_summary_query(spark, sf):
    return rounded(pos_weight_summary(pos_weight(V.scored(spark, sf))))


@query("weighted_bce", sql(f"""
    SELECT round(avg(pos_weight * y * (greatest(-logit, 0) + ln(1 + exp(-abs(logit))))
                     + (1 - y) * (greatest(logit, 0) + ln(1 + exp(-abs(logit))))), 6) AS loss
    FROM logits JOIN (SELECT idx, pos_weight FROM ({CLASS_SQL})) USING (idx)"""))
def weighted_bce(spark, sf):
    rows = V.scored(spark, sf)
    return rounded(M.weighted_bce(rows, pos_weight_vector(pos_weight(rows))))
