"""Sources, sinks, projections, filters, text, label and record functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill import schemas as S
from labelmill.functions.records import (
    broadcast_abstract, default_fields, flatten_struct, papers_to_json, parse_request_batch,
    resolve_id, response_shape, tag_cards, validate_records,
)
from labelmill.functions.scoring import predict, sigmoid_array, threshold_vector
from labelmill.functions.taxonomy import (
    LABELS, binarize_pivot, code_dim, codes_to_labels, has_label, label_dim, multihot,
    multihot_to_labels,
)
from labelmill.functions.text import clean_papers, clean_text, split_categories
from labelmill.operators import curves, profiling, subwords, vocab
from labelmill.plans import prep
from labelmill.plans.tagging import add_tags, join_predictions
from labelmill.registry import views as V
from labelmill.registry.base import ORACLES, query
from labelmill.registry.sql_views import WHITESPACE, clean, sql
from labelmill.session import scratch_path, stored
from labelmill.sources import landing, readers, writers
from labelmill.sources.arrow_dataset import read_dataset, write_dataset

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # a public file; where it lies is a parameter
RAW_SQL = sql("SELECT id, title, abstract, categories, authors, update_date FROM papers_source")


# ---- scans ----

@query("scan_jsonl", RAW_SQL)
def scan_jsonl(spark, sf):
    path = scratch_path(spark, "snapshot")
    V.papers_source(spark, sf).write.json(path)
    return readers.read_papers_jsonl(spark, path)


@query("scan_rejects", "SELECT count(*) AS good, count(*) FILTER (source = 'src0') AS bad FROM documents")
def scan_rejects(spark, sf):
    """A snapshot with a broken line beside some of the papers: none is lost, none is a paper."""
    path = scratch_path(spark, "snapshot")
    rows = V.papers_source(spark, sf)
    line = F.to_json(F.struct(*prep.BASE_COLUMNS))
    broken = F.when(F.col("source") == "src0", F.substring(line, 1, 20))
    rows.select(F.explode(F.array_compact(F.array(line, broken))).alias("value")).write.text(path)
    good, bad = readers.split_bad(readers.read_papers_jsonl(spark, path, keep_bad=True))
    whole = good.select(F.col("id").isNotNull().cast("bigint").alias("good"), F.lit(0).alias("bad"))
    both = whole.unionByName(bad.select(F.lit(0).cast("bigint").alias("good"), F.lit(1).alias("bad")))
    return both.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


@query("recorded_best", sql("""
    SELECT run, max(step) AS best_global_step, round(max(value), 6) AS best_metric FROM (
        SELECT cast(user_id AS varchar) AS run, event_id AS step, value FROM events) GROUP BY run"""))
def recorded_best(spark, sf):
    """The best step that the run states recorded, read back from the state files."""
    path = scratch_path(spark, "states")
    events = V.table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("run"))
    none = F.array().cast(S.TRAIN_LOG["log_history"].dataType)
    states = events.agg(F.max("event_id").alias("best_global_step"), F.max("value").alias("best_metric"))
    states.withColumn("log_history", none).write.json(path)
    best = readers.read_recorded_best(spark, path)
    return best.withColumn("best_metric", F.round("best_metric", 6))


@query("scan_parquet", sql("SELECT id, title, replace(categories, ' ', '|') AS categories, "
                           "update_date FROM catalog_raw"))
def scan_parquet(spark, sf):
    rows = V.catalog(spark, sf).select("id", "title", "categories", "update_date")
    back = stored(rows, "catalog")
    return back.withColumn("categories", V.text_of("categories"))


@query("select_split", sql("SELECT id, labels FROM catalog WHERE n_labels > 0 AND split = 'val'"))
def select_split(spark, sf):
    path = scratch_path(spark, "splits")
    writers.write_splits(V.labelled(spark, sf).select("id", "labels", "split"), path)
    schema = T.StructType([f for f in S.TAXONOMY.fields if f.name in ("id", "labels", "split")])
    rows = readers.select_split(readers.read_stage(spark, path, schema), "val")
    return rows.select("id", V.text_of("labels").alias("labels"))


@query("scan_records", sql(
    "SELECT id, arxiv_id, paper_id, title, abstract, labels FROM records"))
def scan_records(spark, sf):
    path = scratch_path(spark, "records")
    V.records(spark, sf).write.json(path)
    return readers.read_records(spark, path).withColumn("labels", V.text_of("labels"))


@query("scan_csv", sql("SELECT label, count(*) AS count FROM catalog_labels GROUP BY label"))
def scan_csv(spark, sf):
    path = scratch_path(spark, "distribution")
    writers.write_label_counts(profiling.label_distribution(V.catalog(spark, sf)), path)
    return readers.read_label_counts(spark, path)


@query("load_thresholds", sql("SELECT idx, label, threshold FROM threshold_dim"))
def load_thresholds(spark, sf):
    path = scratch_path(spark, "thresholds")
    writers.write_thresholds(V.label_thresholds(spark, sf), path)
    return readers.read_thresholds(spark, path)


def _written_log(spark, sf):
    """Run states on disk, each holding a bounded stretch of one run's log."""
    path = scratch_path(spark, "states")
    entry = F.struct(*[f.name for f in S.LOG_ENTRY.fields])
    block = F.floor(F.col("step") / 512).alias("block")
    states = V.train_log(spark, sf).groupBy("run", block).agg(
        F.array_sort(F.collect_list(entry), lambda a, b: (a["step"] - b["step"]).cast("int"))
        .alias("log_history")
    )
    states.drop("block").write.json(path)
    return readers.read_train_log(spark, path)


@query("scan_log", sql("SELECT * FROM train_log"))
def scan_log(spark, sf):
    return _written_log(spark, sf)


@query("ingest_once", sql("SELECT id, title, categories, update_date FROM catalog_raw"))
def ingest_once(spark, sf):
    path = scratch_path(spark, "landing")
    rows = V.catalog_raw(spark, sf)
    # What a write that died half-way left behind is no landing.
    rows.where(F.crc32("id") % 2 == 0).write.parquet(path)
    landing.ingest_once(rows, path)
    # The second landing finds the first and must change nothing.
    return landing.ingest_once(rows.withColumn("title", F.lit("replaced")), path)


# ---- sinks ----

@query("sink_parquet", sql("SELECT id, title, abstract, replace(categories, ' ', '|') AS "
                           "categories, authors, update_date FROM base"))
def sink_parquet(spark, sf):
    path = scratch_path(spark, "base")
    writers.write_stage(V.papers_base(spark, sf), path)
    back = readers.read_stage(spark, path, S.BASE)
    return back.withColumn("categories", V.text_of("categories"))


@query("sink_split", sql("SELECT id, split, labels FROM catalog WHERE n_labels > 0"))
def sink_split(spark, sf):
    path = scratch_path(spark, "splits")
    writers.write_splits(
        V.labelled(spark, sf).select("id", "labels", "split"), path, files_per_split=4
    )
    back = spark.read.schema("id string, labels array<string>, split string").parquet(path)
    return back.select("id", "split", V.text_of("labels").alias("labels"))


def _tagged(spark, sf):
    rows = add_tags(V.scored(spark, sf), V.label_thresholds(spark, sf))
    return rows.withColumn("true_tags", F.when(F.size("labels") > 0, F.col("labels")))


@query("sink_predictions", sql("""
    SELECT t.id, c.title, case when n_labels > 0 then truth end AS true_tags, predicted, n_tags,
           n_labels = 0 AS null_written
    FROM tagged t JOIN catalog c ON c.id = t.id"""))
def sink_predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    writers.write_predictions(_tagged(spark, sf), path)
    lines = spark.read.text(path)
    schema = S.PREDICTIONS.simpleString()
    rows = lines.select(
        F.from_json("value", schema).alias("r"),
        F.contains("value", F.lit('"true_tags":null')).alias("null_written"),
    )
    return rows.select(
        "r.id", "r.title", V.text_of("r.true_tags").alias("true_tags"),
        V.text_of("r.predicted_tags").alias("predicted"),
        F.size("r.tag_probabilities").cast("bigint").alias("n_tags"), "null_written",
    )


@query("sink_csv", sql("SELECT code AS label, count(*) AS count FROM catalog_codes GROUP BY code"))
def sink_csv(spark, sf):
    path = scratch_path(spark, "codes")
    writers.write_label_counts(
        profiling.label_distribution(V.catalog(spark, sf), "categories"), path
    )
    return readers.read_label_counts(spark, path)


@query("sink_thresholds", sql("SELECT label, threshold FROM label_thresholds"))
def sink_thresholds(spark, sf):
    path = scratch_path(spark, "thresholds")
    writers.write_thresholds(V.label_thresholds(spark, sf), path)
    parsed = spark.read.text(path).select(F.from_json("value", "map<string,double>").alias("m"))
    return parsed.select(F.explode("m").alias("label", "threshold"))


@query("dataset_on_disk", sql("""
    SELECT id, title, labels, split FROM papers WHERE split IN ('val', 'test') AND title >= 'b'"""))
def dataset_on_disk(spark, sf):
    """The taxonomy stage as Arrow shards, read back with two of its splits and four of its columns."""
    path = scratch_path(spark, "dataset")
    write_dataset(V.papers(spark, sf).drop("y"), path)
    rows = read_dataset(spark, path, ["id", "title", "labels", "split"])
    return rows.where("split IN ('val', 'test') AND title >= 'b'").withColumn("labels", V.text_of("labels"))


# ---- projection and filter ----

@query("project_base", RAW_SQL)
def project_base(spark, sf):
    return prep.project_base(V.papers_source(spark, sf))


@query("drop_text", sql("SELECT labels, split FROM papers"))
def drop_text(spark, sf):
    rows = prep.drop_text(V.papers(spark, sf).drop("authors"))
    return rows.select(V.text_of("labels").alias("labels"), "split")


@query("filter_labeled", sql("SELECT id, n_labels FROM catalog WHERE n_labels > 0"))
def filter_labeled(spark, sf):
    rows = V.catalog(spark, sf).where(has_label(F.col("labels")))
    return rows.select("id", F.size("labels").cast("bigint").alias("n_labels"))


@query("retention", sql("SELECT count(*) AS original, count(*) FILTER (n_labels > 0) AS retained "
                        "FROM catalog"))
def retention(spark, sf):
    return profiling.retention(V.catalog(spark, sf))


@query("resolve_id", sql("""
    SELECT s.id AS resolved, r.id, r.arxiv_id, r.paper_id
    FROM records r JOIN shaped s USING (paper)"""))
def resolve(spark, sf):
    rows = V.records(spark, sf)
    return rows.select(resolve_id(rows).alias("resolved"), "id", "arxiv_id", "paper_id")


@query("default_fields", sql("SELECT id, title, abstract FROM shaped"))
def defaults(spark, sf):
    rows = V.records(spark, sf)
    return default_fields(rows).select(resolve_id(rows).alias("id"), "title", "abstract")


@query("validate_records", sql("SELECT id, reject_reason FROM shaped"))
def validate(spark, sf):
    rows = V.records(spark, sf)
    return validate_records(rows).select(resolve_id(rows).alias("id"), "reject_reason")


@query("validate_requests", sql("""
    SELECT p.id AS request, case when source IN ('src6', 'src7') then NULL else r.title end
           AS title,
           case when source IN ('src6', 'src7') then '' else coalesce(r.abstract, '') end
           AS abstract,
           case source when 'src6' then 'empty batch' when 'src7' then 'not a JSON array'
                else s.reject_reason end AS reject_reason
    FROM papers_source p JOIN records r ON r.paper = p.id JOIN shaped s ON s.paper = p.id"""))
def validate_requests(spark, sf):
    """Each paper arrives as a JSON request body, some of them malformed."""
    rows = V.papers_source(spark, sf)
    src = F.col("source")
    title = F.when(src == "src2", "   ").when(src != "src3", F.col("title")).alias("title")
    abstract = F.when(src != "src4", F.col("abstract")).alias("abstract")
    item = F.struct(title, abstract)
    body = (
        F.when(src == "src6", "[]").when(src == "src7", F.to_json(item))
        .otherwise(F.to_json(F.array(item)))
    )
    return parse_request_batch(rows.select(F.col("id").alias("request"), body.alias("body"))).drop(
        "body"
    )


@query("split_log", sql("""
    SELECT 'train' AS kind, run, step, loss AS value FROM train_log
    WHERE loss IS NOT NULL AND eval_loss IS NULL
    UNION ALL SELECT 'eval', run, step, eval_loss FROM train_log WHERE eval_loss IS NOT NULL"""))
def split_log(spark, sf):
    log = V.train_log(spark, sf)
    train = curves.train_rows(log).select(
        F.lit("train").alias("kind"), "run", "step", F.col("loss").alias("value"))
    evals = curves.eval_rows(log).select(
        F.lit("eval").alias("kind"), "run", "step", F.col("eval_loss").alias("value"))
    return train.unionByName(evals)


@query("response_shape", sql("""
    SELECT c.title, predicted, n_tags FROM tagged t JOIN catalog c ON c.id = t.id"""))
def response(spark, sf):
    return response_shape(_tagged(spark, sf)).select(
        "title", V.text_of("predicted_tags").alias("predicted"),
        F.size("tag_probabilities").cast("bigint").alias("n_tags"),
    )


# ---- text and labels ----

@query("clean_text", sql(f"""
    SELECT 'document' AS kind, doc_id AS id, {clean('text')} AS cleaned FROM documents
    UNION ALL SELECT 'page', page_id, {clean("concat(url, ' ', html)")} FROM pages
    UNION ALL SELECT 'turn', conv_id * 100000 + turn, {clean('text')} FROM conversations"""))
def clean_text_query(spark, sf):
    docs = V.table(spark, sf, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = V.table(spark, sf, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"),
        F.concat_ws(" ", "url", "html").alias("text"))
    turns = V.table(spark, sf, "conversations").select(
        F.lit("turn").alias("kind"), (F.col("conv_id") * 100000 + F.col("turn")).alias("id"),
        "text")
    rows = docs.unionByName(pages).unionByName(turns)
    return rows.select("kind", "id", clean_text(F.col("text")).alias("cleaned"))


@query("clean_papers", sql("SELECT id, title, abstract FROM base"))
def clean_papers_query(spark, sf):
    return clean_papers(V.papers_raw(spark, sf)).select("id", "title", "abstract")


@query("split_categories", sql("""
    SELECT id, len(string_split(categories, ' ')) AS n, replace(categories, ' ', '|') AS codes
    FROM catalog_raw"""))
def split_query(spark, sf):
    codes = split_categories(F.col("categories"))
    return V.catalog_raw(spark, sf).select(
        "id", F.size(codes).cast("bigint").alias("n"), V.text_of(codes).alias("codes"))


@query("map_taxonomy", sql("SELECT id, labels FROM catalog"))
def map_taxonomy(spark, sf):
    names = codes_to_labels(split_categories(F.col("categories")))
    return V.catalog_raw(spark, sf).select("id", V.text_of(names).alias("labels"))


@query("label_dim", sql("""
    SELECT idx, d.label, count(id) AS papers
    FROM label_dim d LEFT JOIN catalog_labels l ON l.label = d.label GROUP BY idx, d.label"""))
def label_dim_query(spark, sf):
    counts = profiling.label_distribution(V.catalog(spark, sf))
    rows = label_dim(spark).join(counts, "label", "left")
    return rows.select("idx", "label", F.coalesce("count", F.lit(0)).alias("papers"))


@query("multihot_encode", sql("""
    SELECT id, string_agg(cast(y AS varchar), '' ORDER BY idx) AS y FROM cells GROUP BY id"""))
def multihot_encode(spark, sf):
    y = multihot(F.col("labels"))
    return V.catalog(spark, sf).select("id", V.bits_of(y).alias("y"))


@query("multihot_decode", sql("SELECT id, labels FROM catalog"))
def multihot_decode(spark, sf):
    y = multihot(F.col("labels"))
    return V.catalog(spark, sf).select("id", V.text_of(multihot_to_labels(y)).alias("labels"))


@query("binarize_pivot", sql("SELECT id, " + ", ".join(
    f"""max(case when label = '{x}' then y end) AS "{x}" """ for x in LABELS)
    + " FROM cells GROUP BY id"))
def binarize(spark, sf):
    return binarize_pivot(V.catalog(spark, sf), "id", "labels", LABELS)


@query("sigmoid", sql("SELECT id, idx, round(1 / (1 + exp(-logit)), 6) AS prob FROM logits"))
def sigmoid_query(spark, sf):
    probs = sigmoid_array(F.col("logit"))
    rows = V.scored(spark, sf).select("id", F.posexplode(probs).alias("idx", "prob"))
    return rows.select("id", "idx", F.round("prob", 6).alias("prob"))


@query("predict_scalar", sql("""
    SELECT id, string_agg(case when prob > cast(0.5 AS double) then '1' else '0' end, ''
                          ORDER BY idx) AS p
    FROM cells GROUP BY id"""))
def predict_scalar(spark, sf):
    p = predict(F.col("prob"), threshold_vector(0.5))
    return V.scored(spark, sf).select("id", V.bits_of(p).alias("p"))


@query("predict_per_class", sql("""
    SELECT id, string_agg(case when p then '1' else '0' end, '' ORDER BY idx) AS p,
           string_agg(case when prob >= threshold then '1' else '0' end, '' ORDER BY idx)
           AS p_inclusive
    FROM tags GROUP BY id"""))
def predict_per_class(spark, sf):
    rows = V.scored(spark, sf).withColumn("t", threshold_vector(V.label_thresholds(spark, sf)))
    prob, t = F.col("prob"), F.col("t")
    return rows.select(
        "id", V.bits_of(predict(prob, t)).alias("p"),
        V.bits_of(predict(prob, t, inclusive=True)).alias("p_inclusive"))


@query("predicted_tags", sql("SELECT id, predicted FROM tagged"))
def predicted_tags_query(spark, sf):
    return _tagged(spark, sf).select("id", V.text_of("predicted_tags").alias("predicted"))


@query("tag_probabilities", sql("SELECT id, label, round(prob, 4) AS prob FROM tags WHERE p"))
def tag_probabilities_query(spark, sf):
    entries = F.inline(F.map_entries("tag_probabilities")).alias("label", "prob")
    return _tagged(spark, sf).select("id", entries)


@query("broadcast_abstract", sql("""
    SELECT id, title, (SELECT text FROM documents ORDER BY n_chars, doc_id LIMIT 1) AS abstract
    FROM catalog_raw"""))
def broadcast_abstract_query(spark, sf):
    docs = V.table(spark, sf, "documents")
    shortest = docs.agg(F.min_by("text", F.struct("n_chars", "doc_id"))).scalar()
    return broadcast_abstract(V.catalog_raw(spark, sf).select("id", "title"), shortest)


@query("flatten_struct", """
    SELECT o_orderkey AS "order.key", o_totalprice AS "order.price",
           c_name AS "order.customer.name", c_mktsegment AS "order.customer.segment"
    FROM orders JOIN customer ON c_custkey = o_custkey""")
def flatten(spark, sf):
    orders, customers = V.table(spark, sf, "orders"), V.table(spark, sf, "customer")
    nested = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.struct(
            F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"),
            F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
            .alias("customer"),
        ).alias("order")
    )
    return flatten_struct(nested)


def papers_and_vocab(spark, sf):
    """The papers' ids and texts, written once, and the vocabulary of the train split, written too."""
    papers = stored(V.papers(spark, sf).select("id", "title", "abstract", "split"), "papers")
    return papers, stored(vocab.build_vocab(papers.where(F.col("split") == "train")), "vocab")


@query("build_vocab", sql("SELECT token, token_id, n FROM vocab"))
def build_vocab(spark, sf):
    train = V.papers(spark, sf).where(F.col("split") == "train")
    return vocab.build_vocab(train)


@query("encode_pairs", sql("""
    SELECT id, cast(first_len AS integer) AS first_len, count(*) AS n,
           string_agg(cast(token_id AS varchar), ' ' ORDER BY pos) AS ids
    FROM encoded_tokens GROUP BY id, first_len"""))
def encode_pairs(spark, sf):
    rows = vocab.encode_pairs(*papers_and_vocab(spark, sf))
    segments = F.aggregate("token_type_ids", F.lit(0), lambda a, x: a + x)
    return rows.select(
        "id", (F.size("input_ids") - segments).alias("first_len"),
        F.size("attention_mask").cast("bigint").alias("n"),
        F.array_join("input_ids", " ").alias("ids"))


@query("encode_with_tail", ORACLES["encode_pairs"])
def encode_with_tail(spark, sf):
    """The same ids when only 300 words of the vocabulary are broadcast."""
    rows = vocab.encode_pairs(*papers_and_vocab(spark, sf), head_rows=300)
    segments = F.aggregate("token_type_ids", F.lit(0), lambda a, x: a + x)
    return rows.select(
        "id", (F.size("input_ids") - segments).alias("first_len"),
        F.size("attention_mask").cast("bigint").alias("n"),
        F.array_join("input_ids", " ").alias("ids"))


@query("decode_tokens", sql("""
    SELECT id, string_agg(token, ' ' ORDER BY pos) AS text FROM encoded_tokens GROUP BY id"""))
def decode_tokens(spark, sf):
    papers, table = papers_and_vocab(spark, sf)
    return vocab.decode_tokens(vocab.encode_pairs(papers, table), table)


@query("subword_round_trip", sql("""
    SELECT id, concat(title, ' ', abstract) AS text, true AS fewer_than_bytes FROM base"""))
def subword_round_trip(spark, sf):
    """Texts encoded by a public vocabulary and decoded again, and whether they took fewer ids than bytes."""
    vocabulary = subwords.read_vocabulary(spark, VOCABULARY)
    papers = V.papers_base(spark, sf).select("id", F.concat_ws(" ", "title", "abstract").alias("source"))
    encoded = stored(subwords.encode_subwords(papers, vocabulary, "source", ("id", "source")), "encoded")
    few = F.size("ids") < F.greatest(F.octet_length("source"), F.lit(1))
    back = subwords.decode_subwords(encoded.withColumn("fewer_than_bytes", few), vocabulary, keep=("id", "fewer_than_bytes"))
    return back.select("id", "text", "fewer_than_bytes")


@query("papers_to_json", sql("SELECT id, title, abstract FROM base"))
def to_json(spark, sf):
    rows = V.papers_base(spark, sf)
    parsed = F.from_json(papers_to_json(rows), "title string, abstract string")
    return rows.select("id", parsed.alias("p")).select("id", "p.title", "p.abstract")


@query("tag_cards", sql("""
    SELECT id, coalesce(string_agg(concat(label, ' ', printf('%.1f', case
               when x * 4 = floor(x * 4) AND x * 2 <> floor(x * 2) then x + 0.01 else x end), '%'),
               '|' ORDER BY prob DESC, label) FILTER (p), '') AS bars,
           concat(count(*) FILTER (p), case when count(*) FILTER (p) = 1 then ' tag' else ' tags'
                  end) AS tag_count_text,
           count(*) FILTER (p) = 0 AS no_tags
    FROM (SELECT *, prob * 100 AS x FROM tags) GROUP BY id"""))
def cards(spark, sf):
    return tag_cards(_tagged(spark, sf)).select(
        "id", V.text_of("bars").alias("bars"), "tag_count_text", "no_tags")


# ---- joins and set operations ----

@query("join_codes", sql("SELECT id, label FROM catalog_labels"))
def join_codes(spark, sf):
    return profiling.join_codes(V.catalog(spark, sf), code_dim(spark))


@query("join_large_codes", ORACLES["join_codes"])
def join_large_codes(spark, sf):
    """The same rows when the code table is too large for a map and only 20 of its codes are broadcast."""
    return profiling.join_codes(V.catalog(spark, sf), code_dim(spark), map_bytes=0, head_rows=20)


@query("join_predictions", sql("""
    SELECT c.id, title, labels, predicted FROM catalog c JOIN tagged t ON t.id = c.id"""))
def join_predictions_query(spark, sf):
    tags = _tagged(spark, sf).select("id", V.text_of("predicted_tags").alias("predicted"))
    rows = V.catalog(spark, sf).select("id", "title", V.text_of("labels").alias("labels"))
    return join_predictions(rows, tags)


@query("unmapped_codes", sql("""
    SELECT code, count(*) AS count FROM catalog_codes c
    WHERE code NOT IN (SELECT code FROM codes WHERE label IS NOT NULL) GROUP BY code"""))
def unmapped_codes(spark, sf):
    return profiling.unmapped_codes(V.catalog(spark, sf), code_dim(spark))


@query("label_grid", sql("SELECT id, idx, cast(y AS double) AS y FROM cells"))
def label_grid(spark, sf):
    return profiling.label_grid(V.catalog(spark, sf).withColumn("y", multihot(F.col("labels"))))


@query("prep_job", sql("""
    SELECT e.id, e.split, n, ids, y FROM (
        SELECT id, split, count(*) AS n,
               string_agg(cast(token_id AS varchar), ' ' ORDER BY pos) AS ids
        FROM encoded_tokens GROUP BY id, split) e
    JOIN (SELECT id, string_agg(cast(y AS varchar), '' ORDER BY idx) AS y FROM truth GROUP BY id) t
    ON t.id = e.id"""))
def prep_job(spark, sf):
    stages = prep.prep_job(V.papers_raw(spark, sf), scratch_path(spark, "prep"))
    return stages["encoded"].select(
        "id", "split", F.size("input_ids").cast("bigint").alias("n"),
        F.array_join("input_ids", " ").alias("ids"), V.bits_of("y").alias("y"))
