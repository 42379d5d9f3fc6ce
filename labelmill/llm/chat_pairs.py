"""Preference pairs for chat models: one prompt, two completions, and what is trained on.

A conversation is its turns in order. The chosen and the rejected conversation of a pair are
compared turn by turn; the turns they share from the start are rendered once as the prompt, and
what follows in each is its completion, with the spans of the assistant's own words as the
mask (positions in code points; header marks and other roles are not trained on).

Pairs come from conversations that open with the same turn: they are ordered by how much the
assistant says, and each is chosen over the next, so a group gives one pair less than it has
members, never all pairs. A group of more than ``GROUP`` is dealt to ranges of that order, and each
range also gets the first member of the next, so a first turn that a third of all conversations
share is spread over tasks and its pairs are those of one order. A second kind is made within a
conversation: its last reply is chosen over the reply before, given again.

Turns are ordered by ``turn`` (nulls first), then role and text; a row that is repeated in all
three counts once. Null roles and texts render as empty. Rows without a ``conv_id`` belong to no
conversation and are left out. Control marks inside texts are broken, so a text cannot
end its turn. A pair whose completions are equal or empty is kept but not ``usable``. Columns
other than the four are not read; an empty table gives no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.session import stored

GROUP = 100
BROADCAST_ROWS = 100_000  # large groups, 100 bytes each at most
END = "<|end|>"


def conversations(rows: DataFrame) -> DataFrame:
    """``(conv_id, turns)`` from rows ``(conv_id, turn, role, text)``."""
    turn = F.struct("turn", "role", "text")
    known = rows.where(F.col("conv_id").isNotNull())
    return known.groupBy("conv_id").agg(F.sort_array(F.collect_set(turn)).alias("turns"))


def _plain(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), _plain(turn["role"]), F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(
        F.transform(turns, lambda t: F.concat(_head(t), _plain(t["text"]), F.lit(END + "\n"))), ""
    )


def mask(turns: Column) -> Column:
    """``array<struct<start, end>>``: the assistant's words and end marks in the rendered text."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + F.length(_head(t))
        end = start + F.length(_plain(t["text"])) + len(END)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        own = F.when(t["role"] == "assistant", F.concat(a["spans"], span)).otherwise(a["spans"])
        return F.struct((end + 1).alias("at"), own.alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda a: a["spans"])


def shared_turns(chosen: Column, rejected: Column) -> Column:
    """How many turns two conversations have in common from the start."""

    def same(a: Column, b: Column) -> Column:
        return a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"])

    equal = F.zip_with(chosen, rejected, lambda a, b: a.isNotNull() & b.isNotNull() & same(a, b))
    first_other = F.array_position(F.transform(equal, lambda e: F.coalesce(e, F.lit(False))), False)
    return F.when(first_other == 0, F.size(equal)).otherwise(first_other - 1).cast("int")


def formatted(pairs: DataFrame) -> DataFrame:
    """Prompt, completions and masks of ``pairs(chosen, rejected, ...)``, both arrays of turns."""
    found = pairs.withColumn("n_prompt_turns", shared_turns(F.col("chosen"), F.col("rejected")))
    n = F.col("n_prompt_turns")

    def rest(turns: str) -> Column:
        return F.slice(turns, n + 1, F.size(turns))

    found = found.withColumns({
        "prompt": rendered(F.slice("chosen", F.lit(1), n)),
        "chosen": rest("chosen"), "rejected": rest("rejected"),
    })
    found = found.withColumns({
        "chosen_mask": mask(F.col("chosen")), "rejected_mask": mask(F.col("rejected")),
        "chosen": rendered(F.col("chosen")), "rejected": rendered(F.col("rejected")),
    })
    usable = (F.col("chosen") != "") & (F.col("rejected") != "") & (F.col("chosen") != F.col("rejected"))
    return found.withColumn("usable", usable)


def said(turns: str) -> Column:
    """Code points in the assistant's turns."""
    own = F.filter(turns, lambda t: t["role"] == "assistant")
    return F.aggregate(own, F.lit(0).cast("bigint"), lambda a, t: a + F.coalesce(F.length(t["text"]), F.lit(0)))


def pairs_by_first_turn(convs: DataFrame, group: int = GROUP) -> DataFrame:
    """``(kind, chosen_id, rejected_id, chosen, rejected)`` among conversations with one opening."""
    first = F.struct(F.get("turns", F.lit(0))["role"], F.get("turns", F.lit(0))["text"])
    rows = convs.select("conv_id", "turns", F.sha2(F.to_json(first), 256).alias("opening"), said("turns").alias("said"))
    sizes = convs.select(F.sha2(F.to_json(first), 256).alias("opening")).groupBy("opening").agg(F.count(F.lit(1)).alias("n"))
    large = stored(sizes.where(F.col("n") > group).select("opening", F.lit(True).alias("large")), "openings")
    few = large.count() <= BROADCAST_ROWS
    known = rows.join(F.broadcast(large) if few else large, "opening", "left")
    order = [F.desc("said"), F.asc("conv_id")]
    dealt = known.where("large").drop("large").repartitionByRange(F.col("opening"), *order)
    ranges = stored(dealt.withColumn("part", F.spark_partition_id()), "ranges")
    first = ranges.groupBy("opening", "part").agg(F.min(F.struct(-F.col("said"), F.col("conv_id"))).alias("first"))
    before = F.lag("part").over(Window.partitionBy("opening").orderBy("part"))
    heads = first.select("part", F.col("first.conv_id").alias("conv_id"), before.alias("before")).where("before IS NOT NULL")
    # The first of a range stands behind the range before as well, as a partner only.
    heads = ranges.join(heads, ["part", "conv_id"]).withColumn("part", F.col("before")).drop("before")
    small = known.where("large IS NULL").drop("large").withColumn("part", F.lit(-1))
    members = small.unionByName(ranges).withColumn("head", F.lit(False)).unionByName(heads.withColumn("head", F.lit(True)))
    behind = F.lead(F.struct("conv_id", "turns")).over(Window.partitionBy("opening", "part").orderBy(*order))
    ranked = members.withColumn("next", behind).where(~F.col("head"))
    return ranked.where(F.col("next").isNotNull()).select(
        F.lit("opening").alias("kind"), F.col("conv_id").alias("chosen_id"),
        F.col("next.conv_id").alias("rejected_id"), F.col("turns").alias("chosen"),
        F.col("next.turns").alias("rejected"),
    )


def pairs_by_stale_reply(convs: DataFrame) -> DataFrame:
    """The last reply over the one before, for conversations that end in a second reply."""
    replies = F.filter("turns", lambda t: t["role"] == "assistant")
    last = F.element_at("turns", -1)
    before = F.element_at(replies, -2)["text"]
    stale = F.concat(
        F.slice("turns", F.lit(1), F.size("turns") - 1),
        F.array(F.struct(last["turn"].alias("turn"), last["role"].alias("role"), before.alias("text"))),
    )
    some = convs.where((last["role"] == "assistant") & (F.size(replies) >= 2))
    return some.select(
        F.lit("stale").alias("kind"), F.col("conv_id").alias("chosen_id"),
        F.col("conv_id").alias("rejected_id"), F.col("turns").alias("chosen"), stale.alias("rejected"),
    )


def preference_pairs(rows: DataFrame) -> DataFrame:
    """All pairs of a table of turns, formatted."""
    convs = stored(conversations(rows), "conversations")
    return formatted(pairs_by_first_turn(convs).unionByName(pairs_by_stale_reply(convs)))


def spans_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
