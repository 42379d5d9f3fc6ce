"""Tag records as they arrive, with the batch code on every micro-batch."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from labelmill import schemas as S
from labelmill.functions.records import validate_records
from labelmill.operators.linear_model import LinearModel, weight_parts
from labelmill.plans.tagging import as_records, tag_papers
from labelmill.session import run_folder, stored
from labelmill.sources.files import files_in, path_exists, read_text, remove
from labelmill.sources.writers import write_document

TAGGED, REJECTS, LEDGER = "tagged", "rejects", "ledger"
QUERY_ID = "sql.streaming.queryId"  # Spark's name for the property of a micro-batch
BAD_LINE = "_corrupt_record"  # Spark's name on the way in; a reader would swallow it again
RAW_LINE = "raw_line"  # its name in the rejects
REJECT = "__reject"  # a rejected record as it came


def read_record_stream(
    spark: SparkSession, path: str, schema: T.StructType = S.RECORDS, files_per_batch: int = 100
) -> DataFrame:
    """JSONL files arriving in a folder; a malformed line keeps its text for the rejects."""
    with_bad = T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType())])
    return (
        spark.readStream.schema(with_bad).option("columnNameOfCorruptRecord", BAD_LINE)
        .option("maxFilesPerTrigger", files_per_batch).json(path)
    )


def start_tagging(
    stream: DataFrame, model: LinearModel, out: str, checkpoint: str, thresholds=None,
    **trigger,
) -> StreamingQuery:
    """Write tagged records and rejects under ``out``, a folder of each per micro-batch.

    When both folders of a micro-batch are written, one file in the ledger says so; readers take
    committed batches only, so they see both outputs of a batch or neither. A replayed batch that
    this query has committed is left as it is; one that died, or that comes from another
    checkpoint, is taken out of the ledger and written again. The word aggregate lives inside a
    batch, so the query keeps no state, and what a batch stored on the way goes with it. The
    model is measured once.
    """
    parts = weight_parts(model)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query, entry = spark.sparkContext.getLocalProperty(QUERY_ID), f"{out}/{LEDGER}/{batch_id}"
        if path_exists(spark, entry):
            if query is not None and json.loads(read_text(spark, entry))["query"] == query:
                return
            remove(spark, entry)
        with run_folder(spark, "micro-batch"):
            records = validate_records(batch)
            if BAD_LINE in batch.columns:
                reason = F.when(F.col(BAD_LINE).isNotNull(), "malformed record")
                records = records.withColumn("reject_reason", F.coalesce(reason, "reject_reason"))
            whole = F.struct(*[F.col(c).alias(RAW_LINE if c == BAD_LINE else c) for c in records.columns])
            records = records.withColumn(REJECT, F.when(F.col("reject_reason").isNotNull(), whole))
            records = as_records(records.drop("reject_reason", BAD_LINE))
            # Written once: both outputs read the same rows. Of a valid record, the abstract is not.
            rows = stored(tag_papers(records, model, thresholds, parts=parts), "batch")
            rejects = rows.where(F.col(REJECT).isNotNull()).select(f"{REJECT}.*")
            write_rejects(rejects, f"{out}/{REJECTS}/batch_id={batch_id}")
            write_tagged(rows.where(F.col(REJECT).isNull()), f"{out}/{TAGGED}/batch_id={batch_id}")
        write_document(spark, json.dumps({"query": query, "batch": batch_id}), entry)

    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def write_tagged(tagged: DataFrame, path: str) -> None:
    tagged.select(*[f.name for f in S.PREDICTIONS.fields]).write.mode("overwrite").parquet(path)


def write_rejects(rejects: DataFrame, path: str) -> None:
    rejects.write.mode("overwrite").json(path)


def committed(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the committed micro-batches; only names of files are read."""
    if not path_exists(spark, f"{out}/{LEDGER}"):
        return []
    names = [path.rsplit("/", 1)[-1] for path in files_in(spark, f"{out}/{LEDGER}")]
    return sorted(int(n) for n in names if n.isdigit())


def _read(spark: SparkSession, out: str, kind: str, schema: T.StructType, form: str) -> DataFrame:
    batches = committed(spark, out)
    if not batches:
        return spark.createDataFrame([], schema)
    parted = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(parted).format(form).load(f"{out}/{kind}")
    # Committed batches are a stretch with few gaps; the folders of others are not opened.
    gaps = sorted(set(range(batches[0], batches[-1] + 1)) - set(batches))
    whole = F.col("batch_id").between(batches[0], batches[-1])
    return rows.where(whole & ~F.col("batch_id").isin(gaps) if gaps else whole).drop("batch_id")


def read_tagged(spark: SparkSession, out: str) -> DataFrame:
    """Tagged records of the committed micro-batches."""
    return _read(spark, out, TAGGED, S.PREDICTIONS, "parquet")


def read_rejects(spark: SparkSession, out: str) -> DataFrame:
    """Rejects of the committed micro-batches."""
    schema = T.StructType([*S.RECORDS.fields, T.StructField(RAW_LINE, T.StringType()),
                           T.StructField("reject_reason", T.StringType())])
    return _read(spark, out, REJECTS, schema, "json")
