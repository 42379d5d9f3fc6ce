"""The main text of pages by a linear-chain conditional random field over their blocks.

A page is a sequence of leaf blocks (:mod:`html_blocks`); each is labelled article or other. The
field scores a labelling by the features of every block and by the pairs of neighbouring
labels. Its weights maximise the penalised likelihood of labelled pages (forward-backward, full
gradient, steps scaled per weight), a page is decoded by Viterbi's recursion, and the article blocks are
joined. Training sees a bounded set of labelled pages on the driver; decoding is one row at
a time on the executors, so no page meets another. Bytes that are no UTF-8 are read as U+FFFD.

A null or empty page, and one without any text, gives an empty text. Very long pages are
decoded whole. Repeated rows are decoded alike; other columns pass through, one with the name of
the result is replaced. A table without rows gives none.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.html_blocks import blocks, features
from labelmill.llm.html_labelled import labelled_pages
from labelmill.llm.words import share_package

PENALTY = 1e-4
ROUNDS = 200
RATE = 0.1


@dataclass
class Field:
    """Weights of the labels (0 other, 1 article) by feature, and of label pairs."""

    weights: dict[str, tuple[float, float]]
    pairs: list[list[float]]

    def decode(self, page: list[list[str]]) -> list[int]:
        """The best labelling by Viterbi's recursion."""
        back, (a, b) = [], (0.0, 0.0)
        (oo, oa), (ao, aa) = self.pairs
        for i, names in enumerate(page):
            s0 = s1 = 0.0
            for name in names:
                w = self.weights.get(name)
                if w:
                    s0 += w[0]
                    s1 += w[1]
            if i:
                from0, from1 = a + oo >= b + ao, a + oa >= b + aa
                back.append((0 if from0 else 1, 0 if from1 else 1))
                a, b = s0 + (a + oo if from0 else b + ao), s1 + (a + oa if from1 else b + aa)
            else:
                a, b = s0, s1
        if not page:
            return []
        label = 1 if b > a else 0
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(pages: list[tuple[list[list[str]], list[int]]], penalty: float = PENALTY, rounds: int = ROUNDS) -> Field:
    """Weights from pages of ``(features of every block, label of every block)``."""
    pages = [p for p in pages if p[0]]
    names = sorted({name for found, _ in pages for block in found for name in block})
    column = {name: i for i, name in enumerate(names)}
    longest, n = max(len(found) for found, _ in pages), len(pages)
    live = np.array([[t < len(found) for t in range(longest)] for found, _ in pages])
    labels = np.concatenate([np.array(own, int) for _, own in pages])
    x = np.zeros((len(labels), len(names)), np.float32)  # a row per block, pages in order
    for row, block in zip(x, (block for found, _ in pages for block in found)):
        row[[column[name] for name in block]] = 1
    truth = np.zeros((n, longest, 2))
    truth[live] = np.eye(2)[labels]
    linked = live[:, 1:] & live[:, :-1]
    true_pairs = np.einsum("pta,ptb,pt->ab", truth[:, :-1], truth[:, 1:], linked)
    w, pair = np.zeros((len(names), 2)), np.zeros((2, 2))
    means = [np.zeros_like(w), np.zeros_like(pair)]
    squares = [np.zeros_like(w), np.zeros_like(pair)]
    for turn in range(1, rounds + 1):
        unary = np.zeros((n, longest, 2))
        unary[live] = x @ w.astype(np.float32)
        ahead, behind = unary.copy(), np.zeros_like(unary)
        for t in range(1, longest):
            step = _logsum(ahead[:, t - 1, :, None] + pair, 1) + unary[:, t]
            ahead[:, t] = np.where(live[:, t, None], step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = _logsum(pair + (unary[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(live[:, t + 1, None], step, 0)
        total = _logsum(ahead[:, -1], 1)
        belief = np.exp(ahead + behind - total[:, None, None])
        both = (
            ahead[:, :-1, :, None] + pair + (unary[:, 1:] + behind[:, 1:])[:, :, None, :]
            - total[:, None, None, None]
        )
        pairs_seen = np.exp(both[linked]).sum(0)
        grads = [
            x.T @ (truth[live] - belief[live]).astype(np.float32) / len(labels) - penalty * w,
            (true_pairs - pairs_seen) / len(labels) - penalty * pair,
        ]
        for i, (theta, grad) in enumerate(zip((w, pair), grads)):
            means[i] = 0.9 * means[i] + 0.1 * grad
            squares[i] = 0.99 * squares[i] + 0.01 * grad**2
            fair = np.sqrt(squares[i] / (1 - 0.99**turn)) + 1e-8
            theta += RATE * means[i] / (1 - 0.9**turn) / fair
    return Field({name: (float(w[i, 0]), float(w[i, 1])) for name, i in column.items()}, pair.tolist())


@lru_cache(maxsize=1)
def default_field() -> Field:
    """The field of the pages that are composed by rule."""
    made = []
    for html, labels in labelled_pages():
        found = features(blocks(html))
        if len(found) != len(labels):
            raise ValueError("a labelled page does not have the blocks it was made of")
        made.append((found, [int(x) for x in labels]))
    return train(made)


def field_from(labelled: DataFrame, html: str = "html", text: str = "text", pages: int = 2000) -> Field:
    """A field from a table of pages with their main text, one block per line.

    At most ``pages`` rows, by hash of the page, are used: training is on the driver.
    """
    sample = labelled.orderBy(F.xxhash64(html)).limit(pages).select(html, text).collect()
    made = []
    for page, main in sample:
        found, lines = blocks(page), set((main or "").split("\n"))
        made.append((features(found), [int(b.text in lines) for b in found]))
    return train(made)


def main_text(html: str | None, field: Field) -> str:
    page = blocks(html)
    return "\n".join(b.text for b, keep in zip(page, field.decode(features(page))) if keep)


def extracted(pages: DataFrame, html: str = "html", into: str = "text", field: Field | None = None) -> DataFrame:
    """``pages`` with the main text of ``html``."""
    share_package(pages.sparkSession)
    model = field or default_field()

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(page, model) for page in column], dtype=object)

    made: Column = text_of(F.make_valid_utf8(F.col(html)))
    return pages.withColumn(into, made)
