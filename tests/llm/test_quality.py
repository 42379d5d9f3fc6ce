import random
import re
import string
import zlib
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from labelmill.llm import quality_classifier as Q
from labelmill.llm import quality_rules as R
from tests.llm.cases import documents, none, prose, texts


def by_hand(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = list(zip(w, w[1:], w[2:]))
    times, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "n_bangs": t.count("!"),
    }


def failures(m):
    return [eval(rule, {}, m) for rule in R.RULES.values()]  # noqa: S307


def odd():
    r = random.Random(2)
    return texts() + [" ".join(r.choice("abc") for _ in range(n)) for n in (2, 3, 4, 5, 8, 30, 60, 200)]


def test_the_rule_that_alone_rejects(spark):
    rows = [(1, 0), (2, 1), (3, 64), (4, 65), (5, 4), (6, None)]
    df = spark.createDataFrame(rows, "doc_id int, failed_bits long")
    found = {r.doc_id: (r.a, r.b) for r in df.select("doc_id", R.only_rule().alias("a"), R.only_rule("v1").alias("b")).collect()}
    assert found == {1: (None, None), 2: ("few_words", "few_words"), 3: ("shouting", None), 4: (None, "few_words"), 5: ("symbols", None), 6: (None, None)}


def test_ledger(spark):
    docs = documents(spark, list(enumerate(odd())) + [(0, odd()[0]), (None, None)])
    out = R.ledger(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        want = by_hand(r.text)
        assert {m: r[m] for m in R.MEASURES} == want
        assert r.failed_bits == sum(1 << i for i, bad in enumerate(failures(want)) if bad)
    assert R.ledger(none(spark)).count() == 0


def test_policies_and_ablation(spark):
    docs = documents(spark, list(enumerate(odd())))
    rows = R.ledger(docs)
    bits = [r.failed_bits for r in rows.collect()]
    for policy, rules in R.POLICIES.items():
        mask = sum(R.bit(r) for r in rules)
        assert rows.where(R.passes(policy)).count() == sum(b & mask == 0 for b in bits)
        found = {r.rule: r for r in R.ablation(rows, policy).collect()}
        assert set(found) == set(rules)
        for rule in rules:
            own = R.bit(rule)
            assert found[rule].failing == sum(bool(b & own) for b in bits)
            assert found[rule].only_this == sum(b & mask == own for b in bits)
            assert found[rule].kept_without == sum(b & mask & ~own == 0 for b in bits)
    assert R.ablation(R.ledger(none(spark))).count() == 0


def test_filter_keeps_own_columns(spark):
    docs = documents(spark, list(enumerate(odd())) + [(0, odd()[0])])
    out = R.keep_good(docs)
    assert out.columns == docs.columns
    want = Counter(r.doc_id for r in docs.collect() if not any(failures(by_hand(r.text))))
    assert Counter(r.doc_id for r in out.collect()) == want and len(want) > 3
    assert {r.n_words for r in out.collect()} == {"x"}


def test_ledger_is_one_narrow_stage(spark):
    plan = R.keep_good(documents(spark).coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("regexp_extract_all(") <= 4


def labelled(spark, n=400):
    r = random.Random(1)
    rows = []
    for i in range(n):
        good = r.random() < 0.6
        text = prose(i, r.randint(20, 200))
        if not good:
            text = r.choice([text.replace(" ", "### "), "over and over again " * 30, text.upper().replace(" ", "!! ")])
        rows.append((i, text, int(good)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string").repartition(3)
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"), {i: y for i, _, y in rows}


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy(spark):
    docs, labels, truth = labelled(spark)
    rows = Q.scored(Q.statistics(docs), labels).collect()
    assert len(rows) == 400 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == held(r.doc_id) for r in rows)
    right = [(r.score >= 0.5) == truth[r.doc_id] for r in rows if r.held_out]
    assert sum(right) / len(right) > 0.95


def test_held_out_labels_are_not_learned(spark):
    docs, labels, _ = labelled(spark, 200)
    stats = Q.statistics(docs)
    upside = labels.withColumn("quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in Q.scored(stats, labels).collect()}
    b = {r.doc_id: r.score for r in Q.scored(stats, upside).collect()}
    assert np.allclose([a[i] for i in a], [b[i] for i in a], rtol=1e-9)


def test_expression_is_the_discriminant(spark):
    docs, labels, _ = labelled(spark, 200)
    stats = Q.statistics(docs).join(labels, "doc_id")
    model = Q.fit(stats, "quality")
    rows = stats.withColumn("s", model.score()).collect()
    x = np.array([r["__qda"] for r in rows])
    y = np.array([r.quality for r in rows])
    d = model.log_density(x, 1) - model.log_density(x, 0)
    assert np.allclose([r.s for r in rows], 1 / (1 + np.exp(np.clip(-d, -700, 700))), atol=1e-9)
    # The same density from the covariance itself.
    z = (x - x.mean(0)) / np.where(x.std(0) > 1e-9, x.std(0), 1)
    cov = {c: np.cov(z[y == c].T, bias=True) for c in (0, 1)}
    pooled = sum((y == c).mean() * cov[c] for c in (0, 1))
    for c in (0, 1):
        m = (1 - Q.TO_POOLED) * cov[c] + Q.TO_POOLED * pooled
        p = len(m)
        m = (1 - Q.TO_IDENTITY) * m + Q.TO_IDENTITY * np.trace(m) / p * np.eye(p)
        gap = z - z[y == c].mean(0)
        want = np.log((y == c).mean()) - np.linalg.slogdet(m)[1] / 2 - np.einsum("ij,jk,ik->i", gap, np.linalg.inv(m), gap) / 2
        assert np.allclose(model.log_density(x, c), want, rtol=1e-6, atol=1e-6)


def test_odd_rows_and_missing_labels(spark):
    docs = documents(spark)
    stats = Q.statistics(docs)
    assert stats.count() == docs.count()
    nobody = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.scored(stats, nobody).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(9)] + [(3, None), (None, 0), (4, 7)], "doc_id long, quality int")
    assert {r.score for r in Q.scored(stats, one).collect()} == {1.0}
    both = spark.createDataFrame([(i, i % 2) for i in range(18)] * 2, "doc_id long, quality int")
    rows = Q.scored(stats, both).collect()
    assert len(rows) == docs.count() and all(r.score is not None and 0 <= r.score <= 1 for r in rows)
    assert Q.scored(Q.statistics(none(spark)), both).count() == 0


def test_statistics_of_odd_texts_against_python(spark):
    """Letters beyond ASCII keep their case, words differ by A-Z alone, white space beyond ASCII is no space."""
    odd_texts = odd() + [
        "The the THE tHe", "\u00c4pfel \u00e4pfel \u00c4PFEL \u00c4pfel", "\u0130 i I \u212a k K", "a\u00a0b A\u00a0B\u2003a\x1fb",
        "one two three one two three ONE", "x y z x y z", "\U0001f600A \U0001f600a 1!2?", "  \t\r\n\x0b\x0c ",
    ]
    rows = Q.statistics(documents(spark, list(enumerate(odd_texts)) + [(0, odd_texts[0]), (None, None)])).collect()
    for r in rows:
        text = odd_texts[r.doc_id] if r.doc_id is not None else ""
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
        chars = sum(map(len, words))
        assert np.isclose(r["__qda"][9], np.log1p(100 * len({w.translate(lower) for w in words}) / max(len(words), 1)))
        assert np.isclose(r["__qda"][1], np.log1p(chars / max(len(words), 1)))
        assert np.isclose(r["__qda"][4], np.log1p(100 * by_hand(text)["n_repeat_words"] / max(len(words), 1)))
    assert len(rows) == len(odd_texts) + 2


def test_statistics_split_a_text_once(spark):
    """The whole text is met by no look-up per character, and its words are made once."""
    plan = Q.statistics(documents(spark).coalesce(1))._jdf.queryExecution().optimizedPlan().toString()
    words = f", {R.SPACED_WORD}, 0)"
    assert plan.count(words) == 1
    assert "translate(coalesce(" not in plan and "translate(text" not in plan
