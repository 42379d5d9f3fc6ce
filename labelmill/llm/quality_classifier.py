"""Quality scores from a regularised quadratic discriminant over document statistics.

Each document is reduced to a few statistics of its whole text, put on a logarithmic scale.
Counts, sums and products per class are all that training needs: one aggregate over every
labelled row, whose result has the size of a small matrix. Covariances are shrunk towards the
pooled one and towards a multiple of the identity, factored once (Cholesky), and the inverse
factors go into the scoring expression: the score is the logistic of the difference of the two
log densities, each from a Mahalanobis distance and the factor's log determinant.

Null and empty texts have all statistics at their least and are scored like any other. A label
row counts once for every document with its id; rows with a null or other label are left out.
If either class has no row, every score is the share of label 1 (0.5 without any label).
Repeated rows are scored alike; other columns pass through, one named ``score`` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.quality_rules import measured
from labelmill.llm.words import ascii_lower, spaced_words

STATISTICS = [
    "words", "word_length", "symbols", "dup_lines", "repeats", "bangs", "upper", "digits",
    "punctuation", "distinct",
]
TO_POOLED, TO_IDENTITY = 0.2, 0.05  # shrinkage


def _lowered(word: Column) -> Column:
    """:func:`ascii_lower`; of a word of ASCII alone ``lower`` makes the same, without a look-up per character."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(ascii_lower(word))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``__qda``: the transformed statistics as an array."""
    t = F.coalesce(F.col(text), F.lit(""))
    # Split once, in the case of the text: lowering A-Z cannot make or end a word, so only distinct words are lowered.
    counted = docs.withColumns({
        "__qda_upper": F.regexp_count(t, F.lit(r"\p{Lu}")),
        "__qda_digits": F.regexp_count(t, F.lit("[0-9]")),
        "__qda_points": F.regexp_count(t, F.lit("[.,;:!?]")),
        "__qda_words": spaced_words(t),
    }).withColumn(
        "__qda_distinct", F.size(F.array_distinct(F.transform(F.array_distinct("__qda_words"), _lowered)))
    )
    names = [f"`{c}`" for c in docs.columns if c != text]
    slim = counted.select(
        F.struct(*[F.col(c) for c in names]).alias("__qda_row"), t.alias(text),
        *[c for c in counted.columns if c.startswith("__qda_")],
    )
    m = measured(slim, text, words="__qda_words")

    def share(part: str, whole: str) -> Column:
        return F.log1p(100 * F.col(part) / F.greatest(F.col(whole), F.lit(1)))

    vector = F.array(
        F.log1p("n_words"), F.log1p(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))),
        share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"), share("n_bangs", "n_words"),
        share("__qda_upper", "word_chars"), share("__qda_digits", "word_chars"),
        share("__qda_points", "n_words"), share("__qda_distinct", "n_words"),
    )
    return m.select("__qda_row.*", vector.alias("__qda"))


@dataclass
class Discriminant:
    """Per class: mean, inverse Cholesky factor and the constant of the log density."""

    share: float  # of label 1
    center: np.ndarray
    scale: np.ndarray
    classes: dict[int, tuple[np.ndarray, np.ndarray, float]]

    def score(self, vector: str = "__qda") -> Column:
        if len(self.classes) < 2:
            return F.lit(float(self.share))
        x = [
            (F.get(vector, F.lit(i)) - float(c)) / float(s)
            for i, (c, s) in enumerate(zip(self.center, self.scale))
        ]
        difference = self._log_density(x, 1) - self._log_density(x, 0)
        return 1 / (1 + F.exp(-difference))

    def _log_density(self, x: list[Column], label: int) -> Column:
        mean, inverse, constant = self.classes[label]
        distance = F.lit(0.0)
        for i in range(len(x)):
            z = F.lit(0.0)
            for j in range(i + 1):
                z = z + (x[j] - float(mean[j])) * float(inverse[i, j])
            distance = distance + F.pow(z, F.lit(2.0))
        return F.lit(float(constant)) - distance / 2

    def log_density(self, x: np.ndarray, label: int) -> np.ndarray:
        """The same for rows of a matrix."""
        mean, inverse, constant = self.classes[label]
        z = ((x - self.center) / self.scale - mean) @ inverse.T
        return constant - (z**2).sum(1) / 2


def _products(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def fit(rows: DataFrame, label: str, vector: str = "__qda", to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
    """Fit from all rows whose ``label`` is 0 or 1. A few numbers per class reach the driver."""
    p = len(STATISTICS)
    v = [F.get(vector, F.lit(i)) for i in range(p)]
    sums = rows.where(F.col(label).isin(0, 1)).groupBy(F.col(label).alias("y")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(v[i]).alias(f"s{i}") for i in range(p)],
        *[F.sum(v[i] * v[j]).alias(f"p{i}_{j}") for i, j in _products(p)],
    ).collect()
    n, first, second = {}, {}, {}
    for r in sums:
        y = int(r["y"])
        n[y], first[y] = r["n"], np.array([r[f"s{i}"] for i in range(p)])
        second[y] = np.zeros((p, p))
        for i, j in _products(p):
            second[y][i, j] = second[y][j, i] = r[f"p{i}_{j}"]
    total = sum(n.values())
    if len(n) < 2:
        share = n.get(1, 0) / total if total else 0.5
        return Discriminant(share, np.zeros(p), np.ones(p), {})
    center = sum(first.values()) / total
    spread = np.sqrt(np.maximum(np.diag(sum(second.values())) / total - center**2, 0))
    scale = np.where(spread > 1e-9, spread, 1.0)
    mean, cov = {}, {}
    for y in n:
        mean[y] = (first[y] / n[y] - center) / scale
        raw = second[y] / n[y] - np.outer(first[y], first[y]) / n[y] ** 2
        cov[y] = raw / np.outer(scale, scale)
    pooled = sum(n[y] * cov[y] for y in n) / total
    classes = {}
    for y in n:
        mixed = (1 - to_pooled) * cov[y] + to_pooled * pooled
        level = max(np.trace(mixed) / p, 1e-6)
        factor = np.linalg.cholesky((1 - to_identity) * mixed + to_identity * level * np.eye(p))
        constant = np.log(n[y] / total) - np.log(np.diag(factor)).sum()
        classes[y] = (mean[y], np.linalg.inv(factor), float(constant))
    return Discriminant(n[1] / total, center, scale, classes)


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the key's text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """``docs`` without its text, with ``held_out`` and ``score`` from a fit on the other rows.

    ``docs`` must be stored: it is the output of :func:`statistics`.
    """
    known = labels.select(key, F.col(label).alias("__qda_label"))
    learned = docs.where(~held_out(key)).select(key, "__qda").join(known, key)
    model = fit(learned, "__qda_label")
    return docs.withColumns({"held_out": held_out(key), "score": model.score()}).drop("__qda")
