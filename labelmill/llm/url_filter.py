"""URL verdicts: host and path rules first, a classifier for what no rule decides.

A rule names a host and the start of a path; it fits the host and its subdomains, and the rule
that is longest in characters wins. Everything else is judged by a logistic regression on hashed
character n-grams of host and path, fitted on a small labelled table (below, composed by rule
from words that sites of either kind have in their names).

Rules are looked up, not tried one after another: a URL has one candidate per label of its host,
but no more than the longest rule's host has, which meets the rules by equal key. A list of rules
is sent with the plan and nothing is shuffled; a table of rules, of any size, is joined by host.
No Python runs on the executors.

A null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by the
classifier's bias. Very long URLs are judged whole. Repeated rows are judged alike; columns of the
input pass through, those named like a result are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import random


from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.llm.words import ascii_lower
from labelmill.operators.rows import ROW, numbered
from labelmill.session import scratch_path, stored

SIZES = (3, 4)  # characters in an n-gram
BUCKETS = 1 << 16
PENALTY = 0.0003
SENT_RULES = 10_000  # longer lists go as a table

# The rules that the result is stated in.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

_BLOCKED = (
    "ads adserver adtrack track tracker clickbait popads banner-ads spam spam-farm linkfarm casino casino-win "
    "slots jackpot poker bets free-bets betting lottery pills cheap-pills pharma-deals viagra replica "
    "cheap-watches loans payday-loans crypto-double get-rich xxx porn adult-cams torrent warez crack-keys "
    "free-download seo-links traffic-bot malware phish login-verify win-prize"
).split()
_ALLOWED = (
    "news daily-news blog cooking garden museum library school university science history travel music "
    "weather sports health city council forum docs wiki research journal review books art photo film "
    "nature ocean river mountain recipe family teacher student village theatre poetry astronomy"
).split()
_SYLLABLES = "th ou an er in re on at en nd ti es or te of ed is it al ar st to nt ng se ha as io le ve".split()


def labelled_urls(names: int = 200, seed: int = 5) -> list[tuple[str, int]]:
    """``(url, 1 to block)``: every word under several hosts and paths.

    Beside words that mean something there are ``names`` invented ones, as sites are often
    called. Fronts, endings and paths are dealt alike to both labels, so they tell nothing.
    """
    r = random.Random(seed)
    invented = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(2, 4))) for _ in range(names)]
    made = []
    for label, words in ((1, _BLOCKED), (0, _ALLOWED + invented)):
        for word in words:
            for front in ("", "www.", "m.", "blog.") * 4:
                middle, end = r.choice(("", ".example")), r.choice(("com", "net", "org"))
                tail = r.choice(("", "/", ".html", "?page=2&ref=x", "#top", "?utm_source=feed"))
                lang, page = r.choice(("en", "fr", "de", "es")), r.randint(0, 9999)
                made.append((f"http{r.choice(('', 's'))}://{front}{word}{middle}.{end}/{lang}/{page}{tail}", label))
    return made


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end; A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the end of the host up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def grams(host: str, path: str) -> Column:
    """Character n-grams, those of the host told from those of the path."""

    def of(text: Column, mark: str) -> Column:
        def of_size(chars: Column, n: int) -> Column:
            starts = F.sequence(F.lit(0), F.size(chars) - n)
            made = F.transform(starts, lambda i: F.concat(F.lit(mark), *[F.get(chars, i + k) for k in range(n)]))
            return F.when(F.size(chars) >= n, made).otherwise(F.array().cast("array<string>"))

        chars = F.regexp_extract_all(F.concat(F.lit("^"), text, F.lit("$")), F.lit("(?s)."), F.lit(0))
        return F.transform(F.array(chars), lambda c: F.concat(*[of_size(c, n) for n in SIZES]))[0]

    return F.concat(of(F.col(host), "h:"), of(F.col(path), "p:"))


def split_url(urls: DataFrame, url: str = "url") -> DataFrame:
    return urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})


def _hashing() -> HashingTF:
    return HashingTF(inputCol="__url_grams", outputCol="__url_features", numFeatures=BUCKETS, binary=True)


def fit(labelled: DataFrame, url: str = "url", label: str = "label") -> LogisticRegressionModel:
    """Logistic regression with an L2 penalty; ``label`` is 1 to block. The table is small.

    The model is saved and loaded: a fresh one holds its session, which cannot be sent to tasks.
    """
    rows = split_url(labelled.select(url, F.col(label).cast("double").alias("label")), url)
    rows = _hashing().transform(rows.withColumn("__url_grams", grams("host", "path")))
    share = rows.agg(F.avg("label")).first()[0]
    weight = F.when(F.col("label") == 1, 1 - share).otherwise(share)  # both labels count alike
    model = LogisticRegression(
        featuresCol="__url_features", labelCol="label", weightCol="__url_weight", regParam=PENALTY, maxIter=200, tol=1e-8,
        predictionCol="__url_blocked", probabilityCol="__url_chance", rawPredictionCol="__url_raw",
        standardization=False,
    ).fit(rows.withColumn("__url_weight", weight))
    path = scratch_path(labelled.sparkSession, "url-model")
    model.save(path)
    return LogisticRegressionModel.load(path)


def fit_default(spark: SparkSession) -> LogisticRegressionModel:
    return fit(spark.createDataFrame(labelled_urls(), "url string, label int").coalesce(1))


def parents(host: Column, depth: int | Column) -> Column:
    """The host's own name and those above it, of at most ``depth`` labels."""
    labels = F.split(host, r"\.")
    most = F.least(F.size(labels), F.lit(depth) if isinstance(depth, int) else depth)
    return F.transform(F.sequence(F.lit(1), most), lambda n: F.array_join(F.slice(labels, -n, n), "."))


def _depth(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def rule_column(rules: list[tuple[str, str]], host: str = "host", path: str = "path") -> Column:
    """The longest rule that fits, as ``struct(rule, verdict)``; null if none does."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules:
        name, slash, start = rule.partition("/")
        by_host.setdefault(name.lower(), []).append((slash + start, rule, verdict))
    entry = "array<struct<start:string,rule:string,verdict:string>>"
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    known = F.map_from_entries(F.array(*[
        F.struct(F.lit(name), F.array(*[
            F.struct(F.lit(s).alias("start"), F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for s, r, v in found
        ]).cast(entry)) for name, found in sorted(by_host.items())
    ]))
    none = F.array().cast(entry)
    names = parents(F.col(host), max(name.count(".") + 1 for name in by_host))
    met = F.flatten(F.transform(names, lambda p: F.coalesce(F.element_at(known, p), none)))
    fits = F.filter(met, lambda r: F.startswith(F.col(path), r["start"]))
    best = F.array_sort(F.transform(fits, lambda r: F.struct(
        (-F.length(r["rule"])).alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict")
    )))
    chosen = F.slice(best, 1, 1)
    return F.get(F.transform(chosen, lambda r: F.struct(r["rule"].alias("rule"), r["verdict"].alias("verdict"))), F.lit(0))


def with_rules_of(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows(host, path)`` with ``__url_rule``, from a table ``rules(rule, verdict)`` of any size.

    Every distinct ``(host, path)`` meets the rules of its host's parents by equal host; what met is
    written before the longest is taken, so a host that most URLs share is split by the join.
    Null rules are left out; of equally long ones the first in order of rule and verdict wins.
    """
    name = F.substring_index("rule", "/", 1)
    known = stored(rules.where("rule IS NOT NULL").select(
        F.lower(name).alias("__name"), F.substr("rule", F.length(name) + 1).alias("__start"), "rule", "verdict",
    ), "url-rules")
    deepest = known.agg(F.coalesce(F.max(_depth(F.col("__name"))), F.lit(1))).first()[0]
    numbers = numbered(rows, "urls")
    places = numbers.groupBy("host", "path").agg(F.min(ROW).alias("__place"))
    names = places.select("__place", "path", F.explode(parents(F.col("host"), deepest)).alias("__name"))
    met = names.join(known, "__name").where(F.startswith("path", "__start"))
    met = stored(met.select("__place", F.struct((-F.length("rule")).alias("size"), "rule", "verdict").alias("met")), "url-met")
    best = met.groupBy("__place").agg(F.min("met").alias("met"))
    best = best.select("__place", F.struct("met.rule", "met.verdict").alias("__url_rule"))
    found = stored(places.join(best, "__place", "left").drop("__place"), "url-found")
    return numbers.join(found, ["host", "path"], "left").drop(ROW)


def judged(
    urls: DataFrame, model: LogisticRegressionModel, rules: list[tuple[str, str]] | DataFrame = RULES, url: str = "url",
) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule``, ``block_chance`` and ``verdict``.

    ``block_chance`` is the classifier's, given for every row; ``verdict`` is ``allow`` or
    ``block``, the rule's if one fits. ``rules`` is a list, or a table ``(rule, verdict)``.
    """
    rows = split_url(urls, url)
    if isinstance(rules, list) and len(rules) > SENT_RULES:
        rules = urls.sparkSession.createDataFrame(rules, "rule string, verdict string")
    if isinstance(rules, DataFrame):
        rows = with_rules_of(rows, rules)
    else:
        rows = rows.withColumn("__url_rule", rule_column(rules))
    rows = _hashing().transform(rows.withColumn("__url_grams", grams("host", "path")))
    rows = model.transform(rows).withColumn("block_chance", vector_to_array("__url_chance")[1])
    own = F.when(F.col("block_chance") >= 0.5, "block").otherwise("allow")
    rows = rows.withColumns({
        "rule": F.col("__url_rule.rule"), "verdict": F.coalesce("__url_rule.verdict", own),
    })
    return rows.drop(*[c for c in rows.columns if c.startswith("__url_")])
