"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps what was measured and one
failure bit per rule, so a policy is only a mask over stored bits: changing a policy, or
asking what a rule is worth, never reads a text again. Everything is an expression over
the row; there is no shuffle before the ablation's counts.

Null and empty texts measure zero in everything (and fail ``few_words``). Repeated rows are
judged each for itself. An input column named like a ledger column is replaced by it;
all other columns pass through. An empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.words import SPACED_WORD, spaced_words

MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_bangs",
]

# One rule per bit, in bit order: a document fails a rule whose condition holds.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "shouting": "100 * n_bangs > 50 * n_words",
}
BASE_RULES = ("few_words", "repeated_words")

# Policies are versioned: a version is never changed, only followed by another.
POLICIES = {"v1": BASE_RULES, "v2": tuple(RULES)}
CURRENT = "v2"

_WORDS, _WINDOWS = "__rules_words", "__rules_windows"


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(rules) -> int:
    return sum(bit(r) for r in rules)


# Positions of the windows whose hash occurs again: neighbours in sorted order.
_AGAIN = f"""
transform(
  transform(array(sort_array(arrays_zip({_WINDOWS}, sequence(0, size({_WINDOWS}) - 1)))), s ->
    sort_array(transform(
      filter(s, (e, k) -> e.{_WINDOWS} = get(s, k - 1).{_WINDOWS} OR e.{_WINDOWS} = get(s, k + 1).{_WINDOWS}),
      e -> e.`1`))),
  at -> aggregate(at, struct(-3 AS last, 0 AS n),
    (a, x) -> struct(x AS last, a.n + least(3, x - a.last) AS n), a -> a.n))[0]
"""

_HASHES = f"""
CASE WHEN size({_WORDS}) >= 3 THEN transform(sequence(0, size({_WORDS}) - 3),
  i -> xxhash64({_WORDS}[i], {_WORDS}[i + 1], {_WORDS}[i + 2]))
ELSE cast(array() AS array<bigint>) END
"""


def measured(docs: DataFrame, text: str = "text", words: str | None = None) -> DataFrame:
    """``docs`` with one column per measure.

    ``words`` names a column that has the text's words already; it is left in place.
    A window of three words is compared by its 64-bit hash within its own document, so
    two different windows count as equal with a chance of about 1e-11 in a text of 20,000 words.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda line: line.rlike(SPACED_WORD))
    split = docs.withColumns({_WORDS: F.col(words) if words else spaced_words(t), "__rules_lines": lines})
    counted = split.withColumns({
        _WINDOWS: F.expr(_HASHES),
        "n_words": F.size(_WORDS).cast("bigint"),
        "word_chars": F.length(F.array_join(_WORDS, "")).cast("bigint"),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("bigint"),
        "n_lines": F.size("__rules_lines").cast("bigint"),
        "n_dup_lines": (
            F.size("__rules_lines") - F.size(F.array_distinct("__rules_lines"))
        ).cast("bigint"),
        "n_bangs": F.regexp_count(t, F.lit("!")).cast("bigint"),
    }).drop(_WORDS, "__rules_lines")
    repeats = F.size(F.array_distinct(_WINDOWS)) < F.size(_WINDOWS)
    again = F.when(repeats, F.expr(_AGAIN)).otherwise(F.lit(0)).cast("bigint")
    return counted.withColumn("n_repeat_words", again).drop(_WINDOWS)


def failures(rules: dict[str, str] = RULES) -> Column:
    """One bit per rule that fails, over the measure columns."""
    bits = [F.when(F.expr(c), F.lit(1 << i)).otherwise(0) for i, c in enumerate(rules.values())]
    return sum(bits[1:], bits[0]).cast("bigint")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures and ``failed_bits``; worth storing, everything else reads it.

    The row number is never negative. It keeps filters on the bits above the ledger: pushed below
    it, a condition is spelled out over the text and splits it again for every word.
    """
    bits = F.when(F.monotonically_increasing_id() >= 0, failures())
    return measured(docs, text).withColumn("failed_bits", bits)


def passes(policy: str = CURRENT, bits: str = "failed_bits") -> Column:
    """Whether a ledger row is kept by a policy version."""
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def only_rule(policy: str = CURRENT, bits: str = "failed_bits") -> Column:
    """The one rule of a policy that a ledger row fails; null if it fails none or several."""
    failed = F.col(bits).bitwiseAND(F.lit(mask(POLICIES[policy])))
    found = F.lit(None).cast("string")
    for rule in POLICIES[policy]:
        found = F.when(failed == bit(rule), rule).otherwise(found)
    return found


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """What each rule of a policy is worth, from ledger rows alone.

    ``(policy, rule, failing, only_this, kept_without)``: documents that fail the rule, those
    it alone rejects, and those a policy without it keeps. Bit patterns are counted first, so
    a row per pattern and task is shuffled, not a row per document.
    """
    used = POLICIES[policy]
    bits = F.col("failed_bits").bitwiseAND(F.lit(mask(used)))
    patterns = rows.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).alias("b")) for r in used]))
    n = F.col("n")
    held = patterns.select("bits", "n", rule.alias("r")).select("bits", "n", "r.*")
    return held.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("b")) != 0, n).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("bits") == F.col("b"), n).otherwise(0)).alias("only_this"),
        F.sum(F.when(
            F.col("bits").bitwiseAND(F.bitwise_not("b")) == 0, n
        ).otherwise(0)).alias("kept_without"),
    ).withColumn("policy", F.lit(policy))


def keep_good(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents a policy keeps, with their own columns only.

    The ledger lives in a struct beside the row, so no input column is replaced.
    """
    slim = docs.withColumn("__rules_row", F.struct("*")).select(
        "__rules_row", F.col("__rules_row.text").alias("text")
    )
    return ledger(slim).where(passes(policy)).select("__rules_row.*")
