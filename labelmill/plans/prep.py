"""Raw snapshot to base, taxonomy and encoded stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from labelmill import schemas as S
from labelmill.functions.hashing import hash_split
from labelmill.functions.taxonomy import LABELS, codes_to_labels, has_label, multihot
from labelmill.functions.text import clean_papers, split_categories
from labelmill.operators.sampling import exact_split
from labelmill.operators.vocab import MAX_LENGTH, build_vocab, encode_pairs
from labelmill.sources.readers import BAD_LINE, read_stage, split_bad
from labelmill.sources.writers import write_report, write_splits, write_stage

# The fields of the raw data that are kept.
BASE_COLUMNS = ("id", "title", "abstract", "categories", "authors", "update_date")
TEXT_COLUMNS = BASE_COLUMNS  # what the encoded stage drops
SEED = 42


def project_base(raw: DataFrame) -> DataFrame:
    return raw.select(*BASE_COLUMNS)


def base(raw: DataFrame) -> DataFrame:
    """Six columns, cleaned text, categories as an array. One narrow stage."""
    cleaned = clean_papers(project_base(raw))
    return cleaned.withColumn("categories", split_categories(F.col("categories")))


def taxonomy(base_df: DataFrame, seed: int = SEED, exact: bool = False) -> DataFrame:
    """Label names, unlabelled papers dropped, and a split per paper.

    The default split is a hash of the id and stays narrow; ``exact`` gives split
    sizes to the row at the cost of two small extra passes over the ids.
    """
    labelled = base_df.withColumn("labels", codes_to_labels(F.col("categories")))
    kept = labelled.where(has_label(F.col("labels")))
    if exact:
        return exact_split(kept, seed)
    return kept.withColumn("split", hash_split(F.col("id"), seed))


def with_y(df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    return df.withColumn("y", multihot(F.col("labels"), labels))


def drop_text(df: DataFrame) -> DataFrame:
    """Drop text and metadata columns; absent ones are ignored."""
    return df.drop(*TEXT_COLUMNS)


def encode(
    papers: DataFrame, vocab: DataFrame, max_length: int = MAX_LENGTH, key: str | None = None
) -> DataFrame:
    """Ids, segments, mask and ``y``. ``id`` stays: rows are addressed by it."""
    return encode_pairs(with_y(papers), vocab, max_length, keep=("y", "split"), key=key)


def prep_job(
    raw: DataFrame, out: str, seed: int = SEED, exact: bool = False,
    vocab_size: int | None = None, max_length: int = MAX_LENGTH, write_base: bool = True, key: str | None = None,
) -> dict[str, DataFrame]:
    """Run the whole preparation, one write per stage, and return the written stages.

    The vocabulary comes from the train split only. Without ``write_base`` the text
    goes from the snapshot to the taxonomy stage in one pass and is written once. Malformed lines
    of a snapshot read with ``keep_bad`` go to ``rejects``. ``retention`` tells how many papers the
    snapshot had and how many have a label; both are counted while writing. ``key`` names a column
    of the kept ones that is unique already, if there is one.
    """
    spark = raw.sparkSession
    if BAD_LINE in raw.columns:
        raw, rejects = split_bad(raw)
        rejects.write.mode("overwrite").json(f"{out}/rejects")
    read, kept = Observation("read"), Observation("kept")
    base_df = base(raw)
    if write_base:
        write_stage(base_df.observe(read, F.count(F.lit(1)).alias("n")), f"{out}/base")
        base_df = read_stage(spark, f"{out}/base", S.BASE)
    else:
        base_df = base_df.observe(read, F.count(F.lit(1)).alias("n"))
    labelled = taxonomy(base_df, seed, exact)
    write_splits(labelled.observe(kept, F.count(F.lit(1)).alias("n")), f"{out}/taxonomy")
    before, after = read.get["n"], kept.get["n"]
    write_report(spark.range(1).select(
        F.lit(before).cast("bigint").alias("papers"), F.lit(after).cast("bigint").alias("labelled"),
        F.lit(100.0 * after / before if before else 0.0).alias("percent"),
    ), f"{out}/retention")
    papers = read_stage(spark, f"{out}/taxonomy", S.TAXONOMY)

    write_stage(build_vocab(papers.where(F.col("split") == "train"), vocab_size), f"{out}/vocab")
    vocab = read_stage(spark, f"{out}/vocab", S.VOCAB)

    write_splits(encode(papers, vocab, max_length, key), f"{out}/encoded")
    encoded = read_stage(spark, f"{out}/encoded", S.ENCODED)

    index = F.map_from_arrays(
        F.array(*[F.lit(x) for x in LABELS]), F.array(*[F.lit(i) for i in range(len(LABELS))])
    )
    one = spark.range(1)
    write_report(one.select(index.alias("label_to_index")), f"{out}/label_to_index")
    write_report(
        one.select(
            F.lit(seed).alias("seed"), F.lit(max_length).alias("max_length"),
            F.lit(vocab_size).cast("int").alias("vocab_size"), F.lit(f"{out}/taxonomy").alias("papers"),
            F.lit(f"{out}/encoded").alias("encoded"),
        ),
        f"{out}/encoding_meta",
    )
    return {"base": base_df, "taxonomy": papers, "vocab": vocab, "encoded": encoded}
