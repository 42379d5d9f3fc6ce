"""Corpus vocabulary, pair encoding and decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions.text import clean_text, words
from labelmill.operators.lookup import gathered
from labelmill.operators.rows import ROW, numbered, ranked_rows
from labelmill.session import stored

# Marker tokens and their ids. Words are lower case, so none can collide.
SPECIAL_TOKENS = {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3}
UNKNOWN = SPECIAL_TOKENS["[UNK]"]
MAX_LENGTH = 512  # fixed value: the longest encoded pair


def build_vocab(
    papers: DataFrame, size: int | None = None, columns: tuple[str, ...] = ("title", "abstract")
) -> DataFrame:
    """``(token, token_id, n)``: all words after the marker tokens, the most frequent first.

    Only the ``size`` most frequent if a size is asked for. Counting combines inside each task
    first, and numbering is spread over ranges of the order.
    """
    text = F.concat_ws(" ", *[clean_text(F.col(c)) for c in columns])
    counted = stored(
        papers.select(F.explode(words(text)).alias("token"))
        .groupBy("token").agg(F.count(F.lit(1)).alias("n")),
        "word-counts",
    )
    order = [F.desc("n"), F.asc("token")]
    ranked = ranked_rows(counted, order, "place")
    if size is not None:
        ranked = ranked.where(F.col("place") <= size)
    token_id = (F.col("place") + (len(SPECIAL_TOKENS) - 1)).cast("int")
    words_of = ranked.select("token", token_id.alias("token_id"), "n")
    marks = papers.sparkSession.createDataFrame(
        [(t, i, 0) for t, i in SPECIAL_TOKENS.items()], "token string, token_id int, n bigint"
    )
    return marks.unionByName(words_of)


def _kept(title: Column, abstract: Column, room: int) -> tuple[Column, Column]:
    """Words kept of each side: the longer side is cut first, then both evenly."""
    nt, na = F.size(title), F.size(abstract)
    small, half = F.least(nt, na), room // 2
    other = F.greatest(F.lit(room) - small, F.lit(0))
    short_keeps = F.least(small, F.lit(half))
    long_keeps = F.when(small <= half, other).otherwise(F.lit(room - half))
    fits = nt + na <= room
    return (
        F.when(fits, nt).when(nt <= na, short_keeps).otherwise(long_keeps),
        F.when(fits, na).when(nt <= na, long_keeps).otherwise(short_keeps),
    )


def encode_pairs(
    papers: DataFrame, vocab: DataFrame, max_length: int = MAX_LENGTH,
    keep: tuple[str, ...] = (), head_rows: int | None = None, key: str | None = None,
) -> DataFrame:
    """``[CLS] title [SEP] abstract [SEP]`` as ids, segment ids and mask; ragged, no padding.

    Truncation happens in the row, before the vocabulary, so at most ``max_length`` words per paper
    meet it, and the text is split once however large the vocabulary is. They meet it in the row, so
    a paper keeps its ``id`` and ``keep`` and nothing is written, but for a vocabulary beyond one
    broadcast: then the ids are, once, and the words beyond the head are shuffled. Ids may repeat.
    ``key`` names a column that is unique already, if there is one; then Spark's own aggregate
    gathers the ids of a key, and ``id`` and ``keep`` join back on it.
    """
    columns = list(dict.fromkeys(["id", *keep]))
    told = ["__kept"] if key is None else []
    own = F.struct(*columns).alias("__kept") if key is None else F.col(key)

    def pair(both: Column) -> Column:
        kt, ka = _kept(both["t"], both["a"], max_length - 3)
        sequence = F.concat(
            F.array(F.lit("[CLS]")), F.slice(both["t"], 1, kt), F.array(F.lit("[SEP]")),
            F.slice(both["a"], 1, ka), F.array(F.lit("[SEP]")),
        )
        return F.struct((kt + 2).alias("first_len"), sequence.alias("token"))

    # The words are bound in a lambda: as columns, each of their uses would split the text again.
    sides = [words(clean_text(F.col(c))).alias(name) for c, name in (("title", "t"), ("abstract", "a"))]
    paired = F.get(F.transform(F.array(F.struct(*sides)), pair), F.lit(0))
    tokens = papers.select(own, paired.alias("__pair")).select(*(told or [key]), "__pair.first_len", "__pair.token")
    # Place and id in one number: sorting the numbers sorts the places.
    grouped = gathered(
        tokens, vocab, "token", "n", key, "token_id",
        lambda pos, i: F.shiftleft(pos.cast("bigint"), 32) + F.coalesce(i, F.lit(UNKNOWN)), "seq",
        ("first_len", *told), head_rows=head_rows,
    )
    n = F.size("seq")
    made = grouped.select(
        *([f"__kept.{c}" for c in columns] if key is None else [F.col(key).alias(ROW)]),
        F.transform("seq", lambda s: s.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("input_ids"),
        F.concat(
            F.array_repeat(F.lit(0), F.col("first_len")),
            F.array_repeat(F.lit(1), n - F.col("first_len")),
        ).alias("token_type_ids"),
        F.array_repeat(F.lit(1), n).alias("attention_mask"),
    )
    if key is None:
        return made
    return papers.select(F.col(key).alias(ROW), *columns).join(made, ROW).drop(ROW)


def decode_tokens(
    encoded: DataFrame, vocab: DataFrame, ids: str = "input_ids", head_rows: int | None = None,
    key: str | None = None,
) -> DataFrame:
    """``(id, text)``: the ids' tokens in order, joined by spaces; ids of rows may repeat."""
    if key is None:
        encoded, key = numbered(encoded.select("id", ids)), ROW
    places = encoded.select(key, F.col(ids).alias("token_id"))
    found = gathered(
        places, vocab, "token_id", "n", key, "token",
        lambda pos, t: F.struct(pos.alias("pos"), F.coalesce(t, F.lit("[UNK]")).alias("t")), "seq", head_rows=head_rows, in_row=True,
    )
    told = found.select(key, F.array_join(F.transform("seq", lambda s: s["t"]), " ").alias("text"))
    return encoded.select(F.col(key).alias(ROW), "id").join(told.withColumnRenamed(key, ROW), ROW, "left").select(
        "id", F.coalesce("text", F.lit("")).alias("text")
    )
