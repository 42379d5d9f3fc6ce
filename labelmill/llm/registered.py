"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.llm import (
    chat_pairs, decontaminate, fill_in_middle, html_main_text, minhash_forest, packing, periodic_runs, pseudonyms, quality_classifier, quality_rules,
    sharding, simhash, url_filter,
)
from labelmill.llm.words import table
from labelmill.registry.base import Query
from labelmill.session import stored

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = stored(quality_rules.ledger(docs).drop("text"), "ledger")
    base = F.col("failed_bits").bitwiseAND(F.lit(quality_rules.mask(quality_rules.BASE_RULES)))
    # What the rule that alone rejects a document is worth; a row per rule.
    worth = quality_rules.ablation(rows).select(F.col("rule").alias("only_rule"), "failing", "only_this", "kept_without")
    told = rows.withColumn("only_rule", quality_rules.only_rule())
    return told.join(F.broadcast(worth), "only_rule", "left").select(
        "doc_id", *quality_rules.MEASURES, "failed_bits", (base != 0).alias("base_failed"),
        quality_rules.passes().alias("kept"),
        *[quality_rules.passes(p).alias(f"kept_{p}") for p in quality_rules.POLICIES],
        "only_rule", "failing", "only_this", "kept_without",
    )


ORACLES["op10_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), win AS (
  SELECT k, unnest(generate_series(1, len(w) - 2)) AS i, w FROM w WHERE len(w) >= 3
), twice AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, w[i], w[i + 1], w[i + 2]) AS n FROM win
), covered AS (
  SELECT k, count(DISTINCT i + o) AS n
  FROM twice, (VALUES (0), (1), (2)) AS v(o) WHERE twice.n > 1 GROUP BY k
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(regexp_extract_all(t, '!'))::BIGINT AS n_bangs
  FROM w LEFT JOIN covered c USING (k)
), f AS (
  SELECT *, (
    (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
    + 4 * (100 * n_symbols > 10 * n_words)::BIGINT
    + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT
    + 32 * (word_chars > 15 * n_words)::BIGINT + 64 * (100 * n_bangs > 50 * n_words)::BIGINT
  )::BIGINT AS failed_bits FROM m
), rules AS (
  SELECT 'few_words' AS rule, 1::BIGINT AS b UNION ALL SELECT 'repeated_words', 2 UNION ALL SELECT 'symbols', 4
  UNION ALL SELECT 'repeated_lines', 8 UNION ALL SELECT 'short_words', 16 UNION ALL SELECT 'long_words', 32
  UNION ALL SELECT 'shouting', 64
), worth AS (
  SELECT rule, b, count(*) FILTER (failed_bits & b <> 0) AS failing, count(*) FILTER (failed_bits = b) AS only_this,
    count(*) FILTER (failed_bits & (127 - b) = 0) AS kept_without
  FROM f, rules GROUP BY rule, b
)
SELECT f.*, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits & 3 = 0 AS kept_v1,
  failed_bits = 0 AS kept_v2, rule AS only_rule, failing, only_this, kept_without
FROM f LEFT JOIN worth ON failed_bits = b
"""


@query
def op8_simhash(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


@query
def op1_sharding(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = table(spark, sf, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    placed = sharding.shuffle_into_shards(rows, 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op3_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf, "benchmark"), near=decontaminate.NEAR)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "n_near",
    )


# Near: of the stretches that begin at one of the phrase's words, one of 20 words holds all of them.
ORACLES["op3_decontaminate"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS p
  FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hit AS (
  SELECT DISTINCT k, i, dw.n, item_id FROM dw JOIN bw USING (n, p)
), words AS (
  SELECT k, count(DISTINCT j) AS n_hit
  FROM (SELECT k, unnest(generate_series(i, i + n - 1)) AS j FROM (SELECT DISTINCT k, i, n FROM hit))
  GROUP BY k
), items AS (
  SELECT k, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT k, item_id FROM hit) GROUP BY k
), terms AS (
  SELECT p, unnest(list_distinct(string_split(p, ' '))) AS t FROM (SELECT DISTINCT p FROM bw)
), sizes AS (
  SELECT p, count(*) AS n FROM terms GROUP BY p
), own AS (
  SELECT k, t, list(i ORDER BY i) AS pos FROM (SELECT k, unnest(w) AS t, unnest(range(len(w))) AS i FROM d)
  WHERE t IN (SELECT t FROM terms) GROUP BY k, t
), whole AS (
  SELECT k, p, list(pos) AS places FROM own JOIN terms USING (t) JOIN sizes USING (p) GROUP BY k, p, n HAVING count(*) = n
), near AS (
  SELECT k, count(*) AS n_near FROM whole WHERE len(list_filter(flatten(places), lambda s:
    len(list_filter(places, lambda a: len(list_filter(a, lambda x: x >= s AND x < s + 20)) > 0)) = len(places))) > 0 GROUP BY k
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k) LEFT JOIN near USING (k)
"""


@query
def op5_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymised(docs, pseudonyms.DEMO_KEY)


@query
def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op6_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = stored(quality_classifier.statistics(docs), "statistics")
    found = quality_classifier.scored(rows, table(spark, sf, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op7_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    found = html_main_text.extracted(table(spark, sf, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query
def op2_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    urls = table(spark, sf, "pages").select("page_id", "url")
    found = url_filter.judged(urls, url_filter.fit_default(spark))
    return found.select("page_id", "host", "path", "rule", "verdict", "block_chance")


@query
def op9_chat_pairs(spark: SparkSession, sf: str) -> DataFrame:
    found = chat_pairs.preference_pairs(table(spark, sf, "conversations"))
    return found.withColumns({
        "chosen_mask": chat_pairs.spans_text("chosen_mask"),
        "rejected_mask": chat_pairs.spans_text("rejected_mask"),
    })


ORACLES["op9_chat_pairs"] = r"""
WITH turns AS (
  SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS t
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)
  GROUP BY conv_id
), c AS (
  SELECT conv_id, t, coalesce(list_sum(list_transform(
    list_filter(t, lambda x: x.role = 'assistant'), lambda x: coalesce(length(x.text), 0))), 0) AS said
  FROM turns
), ranked AS (
  SELECT conv_id, t,
    lead(conv_id) OVER w AS next_id, lead(t) OVER w AS next_t
  FROM c WINDOW w AS (
    PARTITION BY t[1].role, t[1].text ORDER BY said DESC, conv_id)
), pairs AS (
  SELECT 'opening' AS kind, conv_id AS chosen_id, next_id AS rejected_id, t AS a, next_t AS b
  FROM ranked WHERE next_id IS NOT NULL
  UNION ALL
  SELECT 'stale', conv_id, conv_id, t, list_append(t[:-2], {'turn': t[-1].turn, 'role': t[-1].role,
    'text': list_filter(t, lambda x: x.role = 'assistant')[-2].text})
  FROM c WHERE t[-1].role = 'assistant' AND len(list_filter(t, lambda x: x.role = 'assistant')) >= 2
), lcp AS (
  SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i:
      i > len(a) OR i > len(b) OR a[i].role IS DISTINCT FROM b[i].role OR a[i].text IS DISTINCT FROM b[i].text)),
    len(a) + 1) - 1 AS n
  FROM pairs
), shown AS (
  SELECT kind, chosen_id, rejected_id, n::INTEGER AS n_prompt_turns,
    list_transform(a, lambda x: '<|' || replace(coalesce(x.role, ''), '<|', '< |') || '|>' || chr(10)) AS ah,
    list_transform(a, lambda x: replace(coalesce(x.text, ''), '<|', '< |') || '<|end|>') AS ax,
    list_transform(a, lambda x: coalesce(x.role = 'assistant', false)) AS ao,
    list_transform(b, lambda x: '<|' || replace(coalesce(x.role, ''), '<|', '< |') || '|>' || chr(10)) AS bh,
    list_transform(b, lambda x: replace(coalesce(x.text, ''), '<|', '< |') || '<|end|>') AS bx,
    list_transform(b, lambda x: coalesce(x.role = 'assistant', false)) AS bo
  FROM lcp
), parts AS (
  SELECT *,
    list_transform(range(1, len(ah) + 1), lambda i: ah[i] || ax[i] || chr(10)) AS pa,
    list_transform(range(1, len(bh) + 1), lambda i: bh[i] || bx[i] || chr(10)) AS pb
  FROM shown
), done AS (
  SELECT *, array_to_string(pa[:n_prompt_turns], '') AS prompt,
    array_to_string(pa[n_prompt_turns + 1:], '') AS chosen, array_to_string(pb[n_prompt_turns + 1:], '') AS rejected,
    array_to_string(list_transform(list_filter(range(n_prompt_turns + 1, len(pa) + 1), lambda i: ao[i]), lambda i:
      (length(array_to_string(pa[n_prompt_turns + 1:i - 1], '')) + length(ah[i]))::VARCHAR || '-' ||
      (length(array_to_string(pa[n_prompt_turns + 1:i - 1], '')) + length(ah[i]) + length(ax[i]))::VARCHAR), ',') AS chosen_mask,
    array_to_string(list_transform(list_filter(range(n_prompt_turns + 1, len(pb) + 1), lambda i: bo[i]), lambda i:
      (length(array_to_string(pb[n_prompt_turns + 1:i - 1], '')) + length(bh[i]))::VARCHAR || '-' ||
      (length(array_to_string(pb[n_prompt_turns + 1:i - 1], '')) + length(bh[i]) + length(bx[i]))::VARCHAR), ',') AS rejected_mask
  FROM parts
)
SELECT kind, chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask,
  rejected_mask, chosen <> '' AND rejected <> '' AND chosen <> rejected AS usable
FROM done
"""


@query
def op13_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, sf, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"),
    )


ORACLES["op13_fill_in_middle"] = r"""
WITH d AS (
  SELECT coalesce(text, '') AS t, doc_id, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), cut AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
      OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), parts AS (
  SELECT doc_id, n, form, t, array_to_string(u[1:least(x, y)], '') AS p,
    array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s
  FROM cut
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM parts
"""


@query
def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = periodic_runs.with_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = periodic_runs.periodic_runs(docs).withColumn("best", periodic_runs.longest_by_exponent())
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# The checksum is folded bit by bit; runs show as stretches of equal windows of eight words, q apart.
ORACLES["op12_periodic_runs"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
      string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END)) AS h
  FROM documents
), cut AS (
  SELECT k, doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a,
    3 + (h // 10) % 8 AS e FROM d
), t AS (
  SELECT k, doc_id, n, w[1:a] || list_transform(range(a, n), lambda i: w[1 + a + (i - a) % (1 + (n - a) // e)]) AS w FROM cut
), win AS (
  SELECT k, n, i, w[i + 1:i + 8] AS s FROM (SELECT *, unnest(range(n - 7)) AS i FROM t)
), again AS (
  SELECT * FROM win QUALIFY count(*) OVER (PARTITION BY k, s) > 1
), pairs AS (
  SELECT x.k, x.i, y.i - x.i AS q FROM again x JOIN again y ON x.k = y.k AND x.s = y.s AND y.i > x.i
  WHERE 3 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT k, q, min(i) AS start, count(*) + 7 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS g FROM pairs)
  GROUP BY k, q, g HAVING count(*) + 7 + q >= greatest(24, 3 * q)
), runs AS (
  SELECT k, start, length, min(q) AS period FROM stretches GROUP BY ALL
), told AS (
  SELECT k, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY k
), best AS (
  SELECT * FROM runs r QUALIFY row_number() OVER (PARTITION BY k ORDER BY
    length // period DESC, (length % period)::DOUBLE / period DESC, start, period) = 1
), gone AS (
  SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT k, string_agg(x, ' ' ORDER BY i) AS words
  FROM (SELECT k, unnest(w) AS x, unnest(range(n)) AS i FROM t) ANTI JOIN gone USING (k, i) GROUP BY k
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(coalesce(words, '')) AS collapsed_sha256
FROM t LEFT JOIN told USING (k) LEFT JOIN best USING (k) LEFT JOIN kept USING (k)
"""


@query
def op11_minhash_forest(spark: SparkSession, sf: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))


ORACLES["op11_minhash_forest"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w WHEN 2 THEN [w[1] || ' ' || w[2]] ELSE list_sort(list_distinct(
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM d
), sets AS (
  SELECT row_number() OVER () AS k, s, len(s) AS n, min(doc_id) AS least FROM s WHERE len(s) > 0 GROUP BY s
), g AS (
  SELECT k, n, unnest(s) AS g FROM sets
), pairs AS (
  SELECT a.k AS a, b.k AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM g a JOIN g b ON a.g = b.g AND a.k <> b.k AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.k, b.k
), links AS (
  SELECT a, b FROM pairs WHERE 100 * c >= 85 * (na + nb - c)
), reach AS (
  SELECT k AS a, k AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), named AS (
  SELECT a AS k, min(least) AS component_id FROM reach JOIN sets ON b = k GROUP BY a
)
SELECT doc_id, len(s.s)::BIGINT AS n_shingles, CASE WHEN len(s.s) = 0 THEN doc_id ELSE component_id END AS component_id,
  doc_id IS NOT DISTINCT FROM CASE WHEN len(s.s) = 0 THEN doc_id ELSE component_id END AS kept
FROM s LEFT JOIN sets ON s.s = sets.s AND sets.n > 0 LEFT JOIN named USING (k)
"""
