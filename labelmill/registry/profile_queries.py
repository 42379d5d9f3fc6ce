"""Distributions, coverage, samples, splits and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.functions.hashing import hash_split
from labelmill.functions.records import tag_ranks
from labelmill.operators import increments, sketches
from labelmill.operators import profiling as P
from labelmill.operators import sampling as G
from labelmill.operators import vocab
from labelmill.plans.tagging import add_tags
from labelmill.registry import views as V
from labelmill.registry.base import ORACLES, query
from labelmill.registry.prep_queries import papers_and_vocab
from labelmill.registry.sql_views import h, split_of, sql
from labelmill.session import scratch_path, stored


@query("label_distribution", sql("""
    SELECT label, count(*) AS count FROM paper_labels GROUP BY label"""))
def label_distribution(spark, sf):
    return P.label_distribution(V.papers(spark, sf)).orderBy(*P.by_frequency())


@query("split_distribution", sql("""
    SELECT split, label, count(*) AS count FROM catalog c JOIN catalog_labels l ON l.id = c.id
    GROUP BY split, label"""))
def split_distribution(spark, sf):
    return P.label_distribution(V.catalog(spark, sf), by=("split",))


SPLIT_COUNTS = """
    (SELECT split, label, count(*) AS n FROM catalog c JOIN catalog_labels l ON l.id = c.id
     GROUP BY split, label)"""


@query("labels_per_paper_stats", sql("""
    SELECT 'labels' AS what, round(avg(n_labels), 6) AS avg_labels,
           cast(max(n_labels) AS integer) AS max_labels,
           cast(min(n_labels) AS integer) AS min_labels FROM catalog
    UNION ALL SELECT 'categories', round(avg(n), 6), cast(max(n) AS integer),
                     cast(min(n) AS integer)
    FROM (SELECT id, count(*) AS n FROM catalog_codes GROUP BY id)"""))
def labels_per_paper_stats(spark, sf):
    rows = V.catalog(spark, sf)

    def stats(column):
        out = P.labels_per_paper_stats(rows, column)
        return out.select(F.lit(column).alias("what"), F.round("avg_labels", 6).alias("avg_labels"),
                          "max_labels", "min_labels")

    return stats("labels").unionByName(stats("categories"))


@query("token_length_stats", sql("""
    SELECT round(avg(n), 6) AS avg_length, round(quantile_cont(n, 0.95), 6) AS p95_length
    FROM (SELECT id, count(*) AS n FROM encoded_tokens GROUP BY id)"""))
def token_length_stats(spark, sf):
    stats = P.token_length_stats(vocab.encode_pairs(*papers_and_vocab(spark, sf)))
    return stats.select(F.round("avg_length", 6).alias("avg_length"),
                        F.round("p95_length", 6).alias("p95_length"))


COVERAGE_SQL = """
    SELECT cast(0 AS integer) AS rank, '' AS label, cast(0 AS bigint) AS covered,
           cast(0 AS double) AS coverage
    UNION ALL
    SELECT rank, label, covered, round(covered / total * 100, 6) FROM (
        SELECT r.rank, r.label, cast(sum(coalesce(n, 0)) OVER (ORDER BY r.rank) AS bigint)
               AS covered, (SELECT cast(count(*) AS double) FROM catalog) AS total
        FROM ranks r LEFT JOIN (
            SELECT first, count(*) AS n FROM (
                SELECT id, min(rank) AS first FROM {items} i JOIN ranks k ON k.label = i.{name}
                GROUP BY id) GROUP BY first) f ON f.first = r.rank)"""


def _coverage_sql(items: str, name: str) -> str:
    ranks = f"""SELECT {name} AS label, cast(row_number() OVER (ORDER BY count(*) DESC, {name})
                AS integer) AS rank FROM {items} GROUP BY {name}"""
    body = COVERAGE_SQL.format(items=items, name=name)
    return sql(f"SELECT * FROM (WITH ranks AS ({ranks}) {body})")


def _coverage(spark, sf, column):
    curve = P.coverage_curve(V.catalog(spark, sf), column)
    return curve.withColumn("coverage", F.round("coverage", 6))


@query("coverage_curve", _coverage_sql("catalog_labels", "label"))
def coverage_curve(spark, sf):
    return _coverage(spark, sf, "labels")


@query("coverage_curve_codes", _coverage_sql("catalog_codes", "code"))
def coverage_curve_codes(spark, sf):
    return _coverage(spark, sf, "categories")


@query("split_probs", sql(f"""
    SELECT split, label, n AS count, round(n / sum(n) OVER (PARTITION BY split), 6) AS prob
    FROM {SPLIT_COUNTS}"""))
def split_probs(spark, sf):
    shares = P.split_probs(P.label_distribution(V.catalog(spark, sf), by=("split",)))
    return shares.withColumn("prob", F.round("prob", 6))


@query("js_divergence", sql(f"""
    SELECT a AS split_a, b AS split_b, round(d, 9) AS js_divergence,
           round(sqrt(d), 6) AS js_distance
    FROM (SELECT a, b, sum(case when p > 0 then p * ln(p / ((p + q) / 2)) else 0 end
                           + case when q > 0 then q * ln(q / ((p + q) / 2)) else 0 end) / 2 AS d
          FROM (SELECT x.split AS a, y.split AS b, coalesce(px.p, 0) AS p, coalesce(py.p, 0) AS q
                FROM (SELECT DISTINCT split FROM {SPLIT_COUNTS}) x
                JOIN (SELECT DISTINCT split FROM {SPLIT_COUNTS}) y ON x.split < y.split
                CROSS JOIN label_dim d
                LEFT JOIN (SELECT split, label, n / sum(n) OVER (PARTITION BY split) AS p
                           FROM {SPLIT_COUNTS}) px ON px.split = x.split AND px.label = d.label
                LEFT JOIN (SELECT split, label, n / sum(n) OVER (PARTITION BY split) AS p
                           FROM {SPLIT_COUNTS}) py ON py.split = y.split AND py.label = d.label)
          GROUP BY a, b)"""))
def js_divergence(spark, sf):
    out = P.js_divergence(P.label_distribution(V.catalog(spark, sf), by=("split",)))
    return out.select("split_a", "split_b", F.round("js_divergence", 9).alias("js_divergence"),
                      F.round("js_distance", 6).alias("js_distance"))


def _landed(spark, sf):
    """A state after three batches, with a replay, a batch that was wrong, a retraction and a merge."""
    papers = stored(V.catalog(spark, sf), "catalog")
    state = scratch_path(spark, "profile")
    part = F.pmod(F.crc32("id"), F.lit(3))
    increments.land(papers.where(part == 0), state, "first")
    increments.land(papers.where(part != 0), state, "second")  # too much: landed again below
    increments.land(papers.where(part == 1), state, "second")
    increments.merge_batches(spark, state, "so-far")
    increments.land(papers.where(part >= 1), state, "third")  # with papers that are there already
    increments.land(papers.where(part == 1), state, "third-again", retract=True)
    increments.land(papers, state, "third-again-and-again")
    increments.withdraw(spark, state, "third-again-and-again")
    return state


@query("profile_increments", sql("""
    SELECT c.split, k.label, count(*) AS count FROM catalog_labels k JOIN catalog c ON c.id = k.id
    GROUP BY c.split, k.label"""))
def profile_increments(spark, sf):
    return increments.profile(spark, _landed(spark, sf))


@query("drift_from_state", ORACLES["js_divergence"])
def drift_from_state(spark, sf):
    out = increments.drift(spark, _landed(spark, sf))
    return out.select("split_a", "split_b", F.round("js_divergence", 9).alias("js_divergence"),
                      F.round("js_distance", 6).alias("js_distance"))


@query("length_sketches", sql("""
    SELECT split, count(*) AS n, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most,
           round(quantile_cont(n, 0.95), 6) AS exact_p95, true AS sketch_is_near
    FROM (SELECT split, length(title) AS n FROM papers) GROUP BY split"""))
def length_sketches(spark, sf):
    """p95 per split from sketches stored per split and day, beside the exact one and the bound's word."""
    rows = stored(V.papers(spark, sf).select("split", "update_date", F.length("title").alias("n")), "lengths")
    kept = stored(sketches.sketched(rows, "n", ("split", "update_date")), "sketches")
    found = stored(sketches.length_summary(kept, ("split",)), "found")
    exact = rows.groupBy("split").agg(F.percentile("n", F.lit(0.95)).alias("exact_p95"))
    off = F.lit(sketches.rank_error())
    near = sketches.rank_bounds(rows, "n", found, ("split",)).select(
        "split", ((F.col("below") - off <= 0.95) & (F.col("upto") + off >= 0.95)).alias("sketch_is_near"))
    return found.join(exact, "split").join(near, "split").select(
        "split", "n", F.round("mean", 6).alias("mean"), F.col("least").cast("bigint"), F.col("most").cast("bigint"),
        F.round("exact_p95", 6).alias("exact_p95"), "sketch_is_near")


@query("align_distributions", sql("""
    SELECT coalesce(a.code, b.code) AS label, coalesce(a.n, 0) AS left_count,
           coalesce(b.n, 0) AS right_count
    FROM (SELECT code, count(*) AS n FROM catalog_codes k JOIN catalog c ON c.id = k.id
          WHERE split = 'train' GROUP BY code) a
    FULL JOIN (SELECT code, count(*) AS n FROM catalog_codes k JOIN catalog c ON c.id = k.id
               WHERE split = 'val' GROUP BY code) b ON a.code = b.code"""))
def align_distributions(spark, sf):
    counts = P.label_distribution(V.catalog(spark, sf), "categories", ("split",))
    train, val = (counts.where(F.col("split") == s) for s in ("train", "val"))
    return P.align_distributions(train, val)


@query("top_bottom", sql("""
    SELECT cast(t.rank AS integer) AS position, t.code AS top_label, t.n AS top_count,
           b.code AS bottom_label, b.n AS bottom_count
    FROM (SELECT *, row_number() OVER (ORDER BY n DESC, code) AS rank
          FROM (SELECT code, count(*) AS n FROM catalog_codes GROUP BY code)) t
    JOIN (SELECT *, 11 - row_number() OVER (ORDER BY n, code DESC) AS rank
          FROM (SELECT code, count(*) AS n FROM catalog_codes GROUP BY code)) b
    ON t.rank = b.rank WHERE t.rank <= 10"""))
def top_bottom(spark, sf):
    return P.top_bottom(P.label_distribution(V.catalog(spark, sf), "categories"), 10)


@query("long_tail", sql("""
    SELECT cast(row_number() OVER (ORDER BY count(*) DESC, code) AS integer) AS rank,
           code AS label, count(*) AS count
    FROM catalog_codes GROUP BY code"""))
def long_tail(spark, sf):
    return P.ranked(P.label_distribution(V.catalog(spark, sf), "categories"))


@query("row_counts", sql("SELECT split, count(*) AS rows FROM catalog WHERE n_labels > 0 "
                         "GROUP BY split"))
def row_counts(spark, sf):
    return P.row_counts(V.labelled(spark, sf))


@query("limit_large", sql("SELECT id, title FROM catalog_raw ORDER BY id LIMIT 11000"))
def limit_large(spark, sf):
    """A limit too large for one task; the rows are filtered where they are."""
    return G.limit_records(V.catalog_raw(spark, sf).select("id", "title"), 11_000)


@query("limit_records", sql("SELECT id, title FROM catalog_raw ORDER BY id LIMIT 200"))
def limit_records(spark, sf):
    return G.limit_records(V.catalog_raw(spark, sf).select("id", "title"), 200)


def _ranked_sql(where: str, seed: int) -> str:
    key = h(f"concat('{seed}:', id)")
    return f"""SELECT id, split, row_number() OVER (ORDER BY {key}, id) AS rn,
                      count(*) OVER () AS n FROM catalog WHERE n_labels > 0 AND {where}"""


@query("sample_ratio", sql(f"""
    SELECT id, split FROM ({_ranked_sql("split = 'train'", 42)})
    WHERE rn <= floor(n * cast(0.135 AS double))
    UNION ALL SELECT id, split FROM ({_ranked_sql("split = 'val'", 43)})
    WHERE rn <= floor(n * cast(0.135 AS double))"""))
def sample_ratio(spark, sf):
    rows = stored(V.labelled(spark, sf).select("id", "split"), "ids")
    train, val = G.sample_train_val(rows, 0.135)
    return train.unionByName(val)


@query("sample_fixed", sql(f"SELECT id, split FROM ({_ranked_sql('true', 42)}) WHERE rn <= 5000"))
def sample_fixed(spark, sf):
    return G.sample_fixed(stored(V.labelled(spark, sf).select("id", "split"), "ids"), 5000)


@query("sample_papers", sql(f"""
    SELECT id, title, abstract FROM base ORDER BY {h("concat('42:', id)")}, id LIMIT 10"""))
def sample_papers(spark, sf):
    return G.sample_papers(V.papers_base(spark, sf).select("id", "title", "abstract"), 10)


@query("hash_split", sql(f"SELECT id, {split_of('id')} AS split FROM catalog_raw"))
def hash_split_query(spark, sf):
    return V.catalog_raw(spark, sf).select("id", hash_split(F.col("id")).alias("split"))


@query("exact_split", sql(f"""
    SELECT id, case when rn <= n - held then 'train'
                    when rn <= n - ceil(held / 2) then 'val' else 'test' end AS split
    FROM (SELECT *, ceil(n * cast(0.2 AS double)) AS held FROM ({_ranked_sql('true', 42)}))"""))
def exact_split(spark, sf):
    return G.exact_split(stored(V.labelled(spark, sf).select("id"), "ids"))


@query("peek_row", sql("SELECT id, title, categories FROM catalog_raw ORDER BY id LIMIT 1"))
def peek_row(spark, sf):
    return G.peek_row(V.catalog_raw(spark, sf).select("id", "title", "categories"))


@query("union_splits", sql("SELECT id, labels, split FROM catalog WHERE n_labels > 0"))
def union_splits(spark, sf):
    rows = V.labelled(spark, sf).select("id", V.text_of("labels").alias("labels"), "split")
    parts = {s: rows.where(F.col("split") == s).drop("split") for s in ("train", "val", "test")}
    return G.union_splits(parts)


@query("tag_rank", sql("""
    SELECT id, label, round(prob, 4) AS prob,
           cast(row_number() OVER (PARTITION BY id ORDER BY prob DESC, label) AS integer) AS rank
    FROM tags WHERE p"""))
def tag_rank(spark, sf):
    return tag_ranks(add_tags(V.scored(spark, sf), V.label_thresholds(spark, sf)))
