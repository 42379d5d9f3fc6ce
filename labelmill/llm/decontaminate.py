"""Benchmark passages found in training texts through a positional inverted index.

The index is a written table with a row per token occurrence: ``(row, pos, term)``, the term as
a 64-bit hash, and one row per document with its key and word count. Phrases are answered
from the index alone. A phrase's terms are ordered by how often the corpus has them; the
postings of the rarest give the candidates (start = position - offset), and the next rarest
lists are intersected with what is left, each shifted by its offset. After the rarest three
lists the few survivors meet all their other terms in one pass.

The corpus side of a join is never sent. Before postings are shuffled on ``(row, pos)``, keys of
which each occurs once, they pass two hashed bit tables: of the terms that are asked for and of the
documents that still have candidates. A bit table has a fixed size however much it is filled; it
lets some others through, never keeps one back, and the exact join follows.

Null and empty texts have no words, no hits and an empty item list. Rows are told apart by a
number of their own, so repeated rows and equal or null keys get one result row each. Items
with a null id count as hits but not as items. An empty corpus gives no rows; an empty
benchmark gives rows without hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.words import alnum_words, without
from labelmill.operators.bits import flag_possible
from labelmill.session import stored

WINDOW = 10
NEAR = 2 * WINDOW  # words within which a phrase's words count as near each other
LISTS = 3  # intersected one by one before the rest are met at once
BROADCAST_BYTES = 32 << 20
_AT = ["row", "pos", "term"]


def _fits(rows: DataFrame, row_bytes: int) -> bool:
    return rows.count() * row_bytes <= BROADCAST_BYTES


def _sent(rows: DataFrame, row_bytes: int) -> DataFrame:
    """Marked for broadcast if its measured size allows; the join's result is the same."""
    return F.broadcast(rows) if _fits(rows, row_bytes) else rows


def _maybe_in(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``rows`` whose ``column`` is in ``wanted``, and a few others."""
    return flag_possible(rows, wanted, column, "__possible").where("__possible").drop("__possible")


def build_index(docs: DataFrame, key: str, text: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """Postings ``(row, pos, term)`` of all texts, and a row ``(row, key, n_words)`` per document.

    With ``vocabulary(term)`` only its terms (and a few others) are stored: all that a known test
    set can ask for. A document's own row has a null ``term``.
    """
    words = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
        alnum_words(F.col(text)).alias("words"),
    )
    with_own = F.concat(F.array(F.lit(None).cast("string")), "words")
    tokens = words.select("row", "key", F.size("words").alias("n_words"), F.posexplode(with_own).alias("at", "word"))
    own = F.col("at") == 0
    postings = tokens.select(
        "row", F.when(own, F.col("key")).alias("key"),
        F.when(own, F.col("n_words")).cast("bigint").alias("n_words"),
        (F.col("at") - 1).alias("pos"), F.when(~own, F.xxhash64("word")).alias("term"),
    )
    if vocabulary is not None:
        known = stored(vocabulary.select("term").distinct(), "vocabulary")
        told = flag_possible(postings, known, "term", "__possible")
        postings = told.where("__possible OR term IS NULL").drop("__possible")
    return stored(postings, "index")


def windows(items: DataFrame, key: str, text: str, size: int = WINDOW) -> DataFrame:
    """``(item, phrase)``: every run of ``size`` words; a shorter item is one phrase."""
    words = items.select(F.col(key).cast("string").alias("item"), alnum_words(F.col(text)).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    some = words.where(F.size("w") > 0).select("item", "w", F.explode(starts).alias("i"))
    return some.select("item", F.array_join(F.slice("w", F.col("i") + 1, F.lit(size)), " ").alias("phrase"))


def phrase_terms(phrases: DataFrame) -> DataFrame:
    """``(phrase_id, length, offset, term)`` of the distinct ``phrase`` values."""
    words = phrases.select("phrase").distinct().select(
        F.xxhash64("phrase").alias("phrase_id"), F.split("phrase", " ").alias("w")
    )
    each = words.select("phrase_id", F.size("w").alias("length"), F.posexplode("w").alias("offset", "word"))
    return each.select("phrase_id", "length", "offset", F.xxhash64("word").alias("term"))


def _by_rarity(index: DataFrame, terms: DataFrame) -> DataFrame:
    """``(phrase_id, length, lists)``: terms from the rarest on; phrases with an unseen term go."""
    # Written first: a word of many phrases may then be split by the join.
    seen = stored(index.where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term-counts")
    ordered = terms.join(seen, "term").groupBy("phrase_id", "length").agg(
        F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("lists")
    )
    return ordered.where("size(lists) = length")


def _met(index: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of ``expected(row, pos, term, ...)`` that the index has."""
    expected = stored(expected, "expected")
    postings = index.where("term IS NOT NULL").select(*_AT)
    postings = _maybe_in(_maybe_in(postings, "row", expected), "term", expected)
    return postings.join(expected, _AT)


def phrase_matches(index: DataFrame, terms: DataFrame) -> DataFrame:
    """``(row, start, length, phrase_id)``: every occurrence of every phrase, exactly."""
    ordered = stored(_by_rarity(index, terms), "phrases")
    table_bytes = 64 + 32 * WINDOW
    postings = index.where("term IS NOT NULL").select(*_AT)
    rarest = ordered.select("phrase_id", F.col("lists")[0]["term"].alias("term"), F.col("lists")[0]["offset"].alias("offset"))
    found = postings.join(_sent(rarest, 96), "term").select(
        "row", (F.col("pos") - F.col("offset")).alias("start"), "phrase_id"
    ).where("start >= 0")
    for k in range(1, LISTS):
        found = stored(found, "candidates")
        nth = F.get("lists", F.lit(k))
        step = ordered.select("phrase_id", nth["term"].alias("term"), nth["offset"].alias("offset"))
        expected = found.join(_sent(step, 96), "phrase_id").withColumn("pos", F.col("start") + F.col("offset"))
        hit = _met(index, expected.where("term IS NOT NULL").select(*_AT, "start", "phrase_id"))
        short = expected.where("term IS NULL").select("row", "start", "phrase_id")
        found = hit.select("row", "start", "phrase_id").unionByName(short)
    found = stored(found, "candidates")
    rest = ordered.select("phrase_id", "length", F.slice("lists", LISTS + 1, 1 << 30).alias("rest"))
    expected = found.join(_sent(rest, table_bytes), "phrase_id")
    whole = expected.where("size(rest) = 0").select("row", "start", "length", "phrase_id")
    each = expected.select("row", "start", "length", "phrase_id", F.size("rest").alias("n"), F.explode("rest").alias("r"))
    each = each.select("row", (F.col("start") + F.col("r.offset")).alias("pos"), F.col("r.term").alias("term"),
                       "start", "length", "phrase_id", "n")
    met = _met(index, each).groupBy("row", "start", "length", "phrase_id", "n").agg(F.count(F.lit(1)).alias("met"))
    return met.where("met = n").select("row", "start", "length", "phrase_id").unionByName(whole)


def proximity_matches(index: DataFrame, terms: DataFrame, within: int) -> DataFrame:
    """``(row, phrase_id, anchor)``: all distinct terms of a phrase, in any order, in ``within`` words.

    ``anchor`` is an occurrence of the phrase's rarest term that lies in such a stretch. The next
    rarest terms are looked for near the anchors one after another, and only anchors that have
    them go on to be checked with all terms. Terms are looked up in ranges of ``4 * within`` positions,
    so the joins are on equal keys and an anchor meets a bounded number of postings.
    """
    distinct = terms.groupBy("phrase_id", "term").agg(F.min("offset").alias("offset"))
    distinct = distinct.withColumn("length", F.lit(0))
    ordered = stored(_by_rarity_all(index, distinct), "near-phrases")
    postings = index.where("term IS NOT NULL").select(*_AT)
    rarest = ordered.select("phrase_id", F.size("lists").alias("n"), F.col("lists")[0]["term"].alias("term"))
    anchors = postings.join(_sent(rarest, 64), "term").select("row", F.col("pos").alias("anchor"), "phrase_id", "n")
    for k in range(1, LISTS):
        anchors = stored(anchors, "anchors")
        nth = ordered.select("phrase_id", F.get("lists", F.lit(k))["term"].alias("term"))
        wanted = anchors.join(_sent(nth, 64), "phrase_id")
        near = _near(index, wanted.where("term IS NOT NULL"), within).select(*anchors.columns).distinct()
        anchors = near.unionByName(wanted.where("term IS NULL").drop("term"))
    anchors, span = stored(anchors, "anchors"), F.lit(within)
    others = ordered.select("phrase_id", F.explode(F.slice("lists", 2, 1 << 30)).alias("o")).select("phrase_id", "o.term")
    near = _near(index, anchors.join(_sent(others, 64), "phrase_id"), within)
    places = near.groupBy("row", "phrase_id", "anchor", "n").agg(F.collect_list(F.struct("pos", "term")).alias("at"))
    # A stretch that holds everything starts at one of the positions or at the anchor.
    starts = F.concat(F.transform("at", lambda x: x["pos"]), F.array("anchor"))
    complete = F.exists(starts, lambda s: (F.col("anchor") >= s) & (F.col("anchor") < s + span) & (
        F.size(F.array_distinct(F.transform(
            F.filter("at", lambda x: (x["pos"] >= s) & (x["pos"] < s + span)), lambda x: x["term"]
        ))) == F.col("n") - 1
    ))
    alone = anchors.where("n = 1").select("row", "phrase_id", "anchor")
    return places.where(complete).select("row", "phrase_id", "anchor").unionByName(alone)


def _near(index: DataFrame, wanted: DataFrame, within: int) -> DataFrame:
    """Rows of ``wanted(row, anchor, term, ...)`` once per posting of the term less than ``within`` away, with its ``pos``."""
    # What is near an anchor lies in one or two ranges of this width, mostly one.
    span, width = F.lit(within), F.lit(4 * within)
    cells = F.array_distinct(F.array(
        F.floor((F.col("anchor") - span + 1) / width), F.floor((F.col("anchor") + span - 1) / width)
    ))
    wanted = stored(wanted.withColumn("cell", F.explode(cells)), "near-wanted")
    postings = index.where("term IS NOT NULL").select(*_AT)
    postings = _maybe_in(_maybe_in(postings, "row", wanted), "term", wanted).withColumn("cell", F.floor(F.col("pos") / width))
    return postings.join(wanted, ["row", "cell", "term"]).where(F.abs(F.col("pos") - F.col("anchor")) < span)


def _by_rarity_all(index: DataFrame, terms: DataFrame) -> DataFrame:
    """As :func:`_by_rarity`, for distinct terms."""
    sizes = terms.groupBy("phrase_id").agg(F.count(F.lit(1)).cast("int").alias("length"))
    return _by_rarity(index, terms.drop("length").join(sizes, "phrase_id"))


# Words covered by intervals in order of their start.
_COVERED = """
aggregate(sort_array(spans), struct(0 AS upto, 0L AS n), (a, s) -> struct(
  greatest(a.upto, s.start + s.length) AS upto,
  a.n + greatest(0, s.start + s.length - greatest(a.upto, s.start)) AS n), a -> a.n)
"""


def contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", size: int = WINDOW, near: int | None = None,
) -> DataFrame:
    """``(key, n_words, n_hit, items)`` per document, for every document; with ``near`` also ``n_near``.

    ``n_hit`` counts the words inside any occurrence of any window of the items, ``items`` lists
    the ids (as sorted strings) of the items with an occurring window. ``n_near`` counts the
    windows whose distinct words the document has, in any order, within ``near`` words.
    """
    own = stored(windows(items, item_key, item_text, size), "windows")
    terms = stored(phrase_terms(own), "terms")
    index = build_index(docs, key, text, terms.select("term"))
    matches = stored(phrase_matches(index, terms), "matches")
    covered = matches.select("row", F.struct("start", "length").alias("span")).distinct()
    covered = covered.groupBy("row").agg(F.collect_list("span").alias("spans"))
    covered = covered.select("row", F.expr(_COVERED).alias("n_hit"))
    which = own.where("item IS NOT NULL").select(F.xxhash64("phrase").alias("phrase_id"), "item").distinct()
    which = stored(which, "which")
    named = matches.select("row", "phrase_id").distinct().join(_sent(which, 128), "phrase_id")
    named = named.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = covered.join(named, "row", "left")
    more = []
    if near is not None:
        close = proximity_matches(index, terms, near).select("row", "phrase_id").distinct()
        found = found.join(close.groupBy("row").agg(F.count(F.lit(1)).alias("n_near")), "row", "full")
        more = [F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near")]
    found = stored(found, "found")
    return index.where("term IS NULL").join(found, "row", "left").select(
        F.col("key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), *more,
    )


def without_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **items_of) -> DataFrame:
    """The documents in which no window of the items occurs, with their own columns."""
    rows = stored(docs.withColumn("__index_row", F.monotonically_increasing_id()), "index-docs")
    report = contamination(rows, items, "__index_row", text, **items_of)
    hit = stored(report.where("n_hit > 0").select("__index_row"), "contaminated")
    return without(rows, hit, "__index_row").drop("__index_row")
