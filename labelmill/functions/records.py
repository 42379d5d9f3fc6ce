"""Request and record shaping: ids, defaults, validation, responses, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.functions.text import WHITESPACE

# The fields that may hold a record's id, in order of preference, and those of a response.
ID_FIELDS = ("id", "arxiv_id", "paper_id")
RESPONSE_FIELDS = ("title", "predicted_tags", "tag_probabilities")


def resolve_id(df: DataFrame, fields: tuple[str, ...] = ID_FIELDS) -> Column:
    """First field that is present and not empty; fields the frame lacks are skipped."""
    present = [F.nullif(F.col(f).cast("string"), F.lit("")) for f in fields if f in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def default_fields(df: DataFrame, fields: tuple[str, ...] = ("title", "abstract")) -> DataFrame:
    """Missing columns and null values of ``fields`` become the empty string."""
    have = set(df.columns)
    return df.withColumns(
        {f: F.coalesce(F.col(f), F.lit("")) if f in have else F.lit("") for f in fields}
    )


def broadcast_abstract(df: DataFrame, abstract: str | Column = "") -> DataFrame:
    """One abstract for every title of the frame."""
    value = F.lit(abstract) if isinstance(abstract, str) else abstract
    return df.withColumn("abstract", F.coalesce(value, F.lit("")))


def reject_reason(title: Column) -> Column:
    """Why a record cannot be tagged, or null when it can."""
    blank = F.rlike(title, F.lit(f"^[{WHITESPACE}]*$"))
    return F.when(title.isNull(), "missing title").when(blank, "blank title")


def validate_records(df: DataFrame) -> DataFrame:
    """Add ``reject_reason``; the caller filters on it for the two outputs."""
    title = F.col("title") if "title" in df.columns else F.lit(None).cast("string")
    return df.withColumn("reject_reason", reject_reason(title))


def parse_request_batch(df: DataFrame, body: str = "body") -> DataFrame:
    """Turn JSON request bodies into records.

    Each body must be a non-empty JSON array of ``{title, abstract}`` objects.
    A bad body yields one row with a reason; every item of a good one yields a row.
    """
    item = T.StructType([
        T.StructField("title", T.StringType()),
        T.StructField("abstract", T.StringType()),
    ])
    is_array = F.rlike(F.col(body), F.lit(r"^\s*\["))
    parsed = F.when(is_array, F.from_json(body, T.ArrayType(item), {"mode": "PERMISSIVE"}))
    bad = (
        F.when(F.col("items").isNull(), "not a JSON array")
        .when(F.size("items") == 0, "empty batch")
    )
    rows = df.withColumn("items", parsed).withColumn("body_reason", bad)
    rows = rows.withColumn("item", F.explode_outer("items")).drop("items")
    title = F.col("item.title")
    return rows.select(
        *[c for c in df.columns],
        title.alias("title"),
        F.coalesce(F.col("item.abstract"), F.lit("")).alias("abstract"),
        F.coalesce(F.col("body_reason"), reject_reason(title)).alias("reject_reason"),
    )


def response_shape(df: DataFrame) -> DataFrame:
    return df.select(*RESPONSE_FIELDS)


def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested struct fields as top-level columns named by their dotted path."""

    def leaves(schema: T.StructType, prefix: tuple[str, ...]):
        for field in schema.fields:
            path = (*prefix, field.name)
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, path)
            else:
                yield path

    def dotted(path):
        return F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path))

    return df.select(*[dotted(p) for p in leaves(df.schema, ())])


def papers_to_json(df: DataFrame, fields: tuple[str, ...] = ("title", "abstract")) -> Column:
    return F.to_json(F.struct(*fields))


def percent_text(prob: Column) -> Column:
    """A probability as percent with one decimal, as JavaScript's ``toFixed(1)`` prints it.

    The binary value decides the rounding; an exact half (``12.25``) goes up.
    """
    x = prob * 100
    exact_half = (x * 4 == F.floor(x * 4)) & (x * 2 != F.floor(x * 2))
    return F.concat(F.format_number(F.when(exact_half, x + 0.01).otherwise(x), 1), F.lit("%"))


def ranked_tags(tag_probabilities: Column) -> Column:
    """``array<struct(order, label, prob)>`` by falling probability, then name."""
    entries = F.transform(
        F.map_entries(tag_probabilities),
        lambda e: F.struct((-e["value"]).alias("order"), e["key"].alias("label"),
                           e["value"].alias("prob")),
    )
    return F.array_sort(entries)


def tag_ranks(df: DataFrame, key: str = "id") -> DataFrame:
    """``(key, label, prob, rank)`` of each paper's tags.

    A paper's tags sit in its row, so they are ranked there and nothing is shuffled.
    """
    rows = df.select(key, F.posexplode(ranked_tags(F.col("tag_probabilities"))).alias("pos", "t"))
    return rows.select(key, "t.label", "t.prob", (F.col("pos") + 1).alias("rank"))


def tag_cards(df: DataFrame) -> DataFrame:
    """Display card per tagged paper: bars by falling probability, percent, count, flag."""
    bars = F.transform(
        ranked_tags(F.col("tag_probabilities")),
        lambda e: F.concat(e["label"], F.lit(" "), percent_text(e["prob"])),
    )
    n = F.size("predicted_tags")
    return df.withColumns({
        "bars": bars,
        "tag_count": n,
        "tag_count_text": F.concat(n.cast("string"), F.when(n == 1, " tag").otherwise(" tags")),
        "no_tags": n == 0,
    })
