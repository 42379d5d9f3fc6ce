"""Explicit schemas of every stage; nothing is inferred from data."""

from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())
_DOUBLES = T.ArrayType(T.DoubleType())
_INTS = T.ArrayType(T.IntegerType())


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


RAW = _schema(
    id=T.StringType(), title=T.StringType(), abstract=T.StringType(),
    categories=T.StringType(), authors=T.StringType(), update_date=T.StringType(),
)
BASE = _schema(
    id=T.StringType(), title=T.StringType(), abstract=T.StringType(),
    categories=_STRINGS, authors=T.StringType(), update_date=T.StringType(),
)
TAXONOMY = T.StructType(
    [*BASE.fields, T.StructField("labels", _STRINGS), T.StructField("split", T.StringType())]
)
ENCODED = _schema(
    id=T.StringType(), y=_DOUBLES, input_ids=_INTS, token_type_ids=_INTS, attention_mask=_INTS,
    split=T.StringType(),
)
LABEL_COUNTS = _schema(label=T.StringType(), count=T.LongType())
RECORDS = _schema(
    id=T.StringType(), arxiv_id=T.StringType(), paper_id=T.StringType(),
    title=T.StringType(), abstract=T.StringType(), labels=_STRINGS,
)
PREDICTIONS = _schema(
    id=T.StringType(), title=T.StringType(), true_tags=_STRINGS, predicted_tags=_STRINGS,
    tag_probabilities=T.MapType(T.StringType(), T.DoubleType()),
)
LOG_ENTRY = _schema(
    step=T.LongType(), loss=T.DoubleType(), learning_rate=T.DoubleType(),
    eval_loss=T.DoubleType(), eval_f1=T.DoubleType(), eval_f1_weighted=T.DoubleType(),
    eval_precision=T.DoubleType(), eval_recall=T.DoubleType(),
)
TRAIN_LOG = _schema(
    run=T.StringType(), log_history=T.ArrayType(LOG_ENTRY),
    best_global_step=T.LongType(), best_metric=T.DoubleType(),
)
VOCAB = _schema(token=T.StringType(), token_id=T.IntegerType(), n=T.LongType())
