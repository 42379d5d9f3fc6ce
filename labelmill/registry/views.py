"""Papers, records, scores and logs derived from the test tables with Spark.

``papers_raw`` is one paper per row of ``documents``; ``catalog`` is one
(textless) paper per row of ``orders``, for the operators that need labels but no
text. Both read their whole tables. The SQL twins are in :mod:`sql_views`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill import schemas as S
from labelmill.functions.hashing import hash_split, row_hash
from labelmill.functions.scoring import logit
from labelmill.functions.taxonomy import (
    CODE_TO_LABEL, LABELS, codes_to_labels, has_label, label_array, multihot, name_array,
)
from labelmill.functions.text import split_categories
from labelmill.operators.bits import flag_possible
from labelmill.plans.prep import base, taxonomy, with_y

# Codes that occur but have no label.
UNMAPPED = ["comp-gas", "cs.GL", "cs.OH"]
CODES = sorted([*CODE_TO_LABEL, *UNMAPPED])
# A code for each language, so that words carry some signal.
LANG_CODES = {"de": "hep-th", "en": "cs.LG stat.ML", "es": "q-bio.NC", "fr": "math.CO"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a bare scan dealt over tasks: the test tables are single small files."""
    return df.repartition(key)


def day(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def met_by(rows: DataFrame, key: str, wanted: DataFrame | None) -> DataFrame:
    """``rows`` without most of those whose ``key`` the one column of ``wanted`` lacks; a join must follow."""
    if wanted is None:
        return rows
    return flag_possible(rows, wanted.toDF(key), key, "__possible").where("__possible").drop("__possible")


def order_codes(spark: SparkSession, sf: str, wanted: DataFrame | None = None) -> DataFrame:
    """``(l_orderkey, codes)``: the distinct codes of an order, long-tailed over the code list.

    The set is bounded by the code list and combines before the shuffle. Of other orders than the
    ``wanted`` ones, few are there.
    """
    r = F.col("l_partkey") % 200
    idx = F.floor(r * r * len(CODES) / 40_000).cast("int")
    code = F.element_at(name_array(CODES), idx + 1)
    lines = table(spark, sf, "lineitem").select("l_orderkey", code.alias("code"))
    lines = met_by(lines, "l_orderkey", wanted)
    return lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def catalog_raw(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, title, categories, update_date)``, one row per order."""
    orders = spread(table(spark, sf, "orders"), "o_orderkey")
    found = orders.join(
        order_codes(spark, sf), F.col("o_orderkey") == F.col("l_orderkey"), "left"
    )
    return found.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("title"),
        F.coalesce(F.array_join("codes", " "), F.lit("cs.OH")).alias("categories"),
        day("o_orderdate").alias("update_date"),
    )


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog with ``categories`` as an array, ``labels`` and ``split``; unlabelled rows kept."""
    split = catalog_raw(spark, sf).withColumn("categories", split_categories(F.col("categories")))
    return split.withColumns({
        "labels": codes_to_labels(F.col("categories")), "split": hash_split(F.col("id")),
    })


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return catalog(spark, sf).where(has_label(F.col("labels")))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog with truth ``y`` and made-up but reproducible ``prob`` and ``logit`` vectors."""

    def prob(cell: Column, i: Column) -> Column:
        u = cell["h"] % (10_007 + 2 * i) % 10_000
        return (200 + 3500 * cell["y"].cast("bigint") + F.floor(u * 6 / 10)) / 10_000

    # Labels are bound once a row: inside the lambdas below each class would work them out again.
    y = F.get(F.transform(F.array("labels"), lambda names: multihot(names)), F.lit(0))
    rows = catalog(spark, sf).withColumn("y", y)
    h = F.array_repeat(row_hash(F.col("id"), 7), len(LABELS))
    rows = rows.withColumn("prob", F.transform(F.arrays_zip("y", h.alias("h")), prob))
    return rows.withColumn("logit", F.transform("prob", logit))


def order_facts(spark: SparkSession, sf: str) -> DataFrame:
    """``(key, c_name, o_orderdate, codes)`` of each document's key, a row for each order and customer it meets.

    The keys meet the larger tables alone, and only the rows of those tables that they may meet move.
    """
    wanted = table(spark, sf, "documents").select(F.col("doc_id").alias("key")).where("key IS NOT NULL")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    orders = met_by(orders, "o_orderkey", wanted)
    names = table(spark, sf, "customer").select("c_custkey", "c_name")
    return (
        wanted.distinct().join(orders, F.col("key") == F.col("o_orderkey"), "left")
        .join(order_codes(spark, sf, wanted), F.col("key") == F.col("l_orderkey"), "left")
        .join(names, F.col("o_custkey") == F.col("c_custkey"), "left")
        .select("key", "c_name", "o_orderdate", "codes")
    )


def papers_source(spark: SparkSession, sf: str) -> DataFrame:
    """Raw papers with their ``source``, one row per document.

    The texts are dealt once, and not sorted: what the other tables say of a document is short and is hashed.
    """
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    facts = order_facts(spark, sf).hint("shuffle_hash")
    found = spread(docs, "doc_id").join(facts, F.col("doc_id") == F.col("key"), "left")
    by_lang = F.create_map(*[F.lit(x) for kv in sorted(LANG_CODES.items()) for x in kv])
    codes = F.concat_ws(" ", F.element_at(by_lang, F.col("lang")), F.array_join("codes", " "))
    key = F.col("doc_id").cast("string")
    return found.select(
        key.alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat("text", F.lit(" http://example.com/"), key).alias("abstract"),
        F.when(F.col("source") == "src19", "cs.OH").otherwise(codes).alias("categories"),
        F.col("c_name").alias("authors"), day("o_orderdate").alias("update_date"), "source",
    )


def papers_raw(spark: SparkSession, sf: str) -> DataFrame:
    return papers_source(spark, sf).drop("source")


def papers_base(spark: SparkSession, sf: str) -> DataFrame:
    return base(papers_raw(spark, sf))


def papers(spark: SparkSession, sf: str) -> DataFrame:
    """Taxonomy stage: cleaned text, labels, split, and ``y``."""
    return with_y(taxonomy(papers_base(spark, sf)))


def all_papers(spark: SparkSession, sf: str) -> DataFrame:
    """As :func:`papers`, with those that have no label."""
    rows = papers_base(spark, sf).withColumn("labels", codes_to_labels(F.col("categories")))
    return with_y(rows.withColumn("split", hash_split(F.col("id"))))


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Records as they may arrive: ids under several names, blank titles, absent fields."""
    rows = papers_source(spark, sf)
    src, key = F.col("source"), F.col("id")
    names = codes_to_labels(split_categories(F.col("categories")))
    return rows.select(
        F.when(src == "src0", None).when(src == "src1", "").otherwise(key).alias("id"),
        F.when(src == "src0", F.concat(F.lit("a"), key)).when(src == "src1", "").alias("arxiv_id"),
        F.when(src == "src1", F.concat(F.lit("p"), key)).alias("paper_id"),
        F.when(src == "src2", "   ").when(src != "src3", F.col("title")).alias("title"),
        F.when(src != "src4", F.col("abstract")).alias("abstract"),
        F.when(src != "src5", names).alias("labels"),
    ).to(S.RECORDS)


def train_log(spark: SparkSession, sf: str) -> DataFrame:
    """Log rows ``(run, step, loss, …)``: a run per user, a step per event.

    A purchase is an evaluation entry, any other event a training entry.
    """
    e = table(spark, sf, "events")
    is_eval = F.col("event_type") == "purchase"
    v = F.col("value")
    entry = {
        "loss": F.when(~is_eval, F.sqrt(v)), "learning_rate": F.when(~is_eval, v / 1000),
        "eval_loss": F.when(is_eval, v), "eval_f1": F.when(is_eval, v / (v + 1)),
        "eval_f1_weighted": F.when(is_eval, v / (v + 2)),
        "eval_precision": F.when(is_eval, v / (v + 3)),
        "eval_recall": F.when(is_eval, v / (v + 4)),
    }
    return e.select(
        F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("step"),
        *[c.alias(n) for n, c in entry.items()],
    )


def label_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """``(label, threshold)``: mean score of the true papers; the Q labels are left out."""
    cells = scored(spark, sf).select(F.posexplode(F.arrays_zip("y", "prob")).alias("idx", "c"))
    true = cells.where(F.col("c.y") == 1).select(
        F.get(label_array(), F.col("idx")).alias("label"),
        F.round(F.col("c.prob") * 10_000).cast("bigint").alias("u"),
    )
    mean = F.sum("u") / F.count(F.lit(1)) / 10_000
    per_label = true.groupBy("label").agg(F.round(mean, 4).alias("threshold"))
    return per_label.where(~F.col("label").startswith("Q"))


def text_of(names: str | Column) -> Column:
    """An array as one string, so results compare as plain values."""
    return F.array_join(names, "|")


def bits_of(flags: str | Column) -> Column:
    """A 0/1 or boolean vector as a string of digits."""
    return F.array_join(F.transform(flags, lambda x: x.cast("int").cast("string")), "")
