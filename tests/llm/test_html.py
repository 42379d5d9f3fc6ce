import html as references
import itertools
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelmill.llm import html_main_text as M
from labelmill.llm.html_blocks import blocks, features
from labelmill.llm.html_labelled import labelled_pages


@pytest.fixture(scope="module")
def field():
    return M.default_field()


def texts(page):
    return [b.text for b in blocks(page)]


@pytest.mark.parametrize("page,want", [
    (None, []), ("", []), ("plain", ["plain"]), ("<p>a<p>b", ["a", "b"]), ("<p><b>a<br><p>b</p>", ["a", "b"]),
    ("<div>a<span>b</span> <i>c</i>\n\t d<div>e</div>f</div>", ["ab c d", "e", "f"]),
    ("<p>&lt;b&gt; &amp;amp; &eacute;&#233;&nbsp;x</p>", ["<b> &amp; éé x"]),
    ("<script>var t='</p>';</script><style>p{}</style><p>x", ["x"]),
    ("<head><title>t</title></head><body>x", ["x"]), ("<title>t</title><p>x", ["x"]),
    ("<!-- a <p>b</p> --><p>x<!--y--></p>", ["x"]), ("<![CDATA[ z ]]><p>x", ["x"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
    ("<p>a</b></i>b</p></div>c", ["ab", "c"]), ("a<hr>b<br/>c<img src=x>d", ["a", "b cd"]),
    ("<p>\U0001f600 漢字</p>", ["\U0001f600 漢字"]), ("<p " + "x=1 " * 5000 + ">y", ["y"]),
    ("<noscript>n</noscript><template><p>t</p></template><p>x", ["x"]),
])
def test_blocks(page, want):
    assert texts(page) == want


@pytest.mark.parametrize("page,want", [
    ("<html><head><title>T</title><h1>A</h1><p>long article", ["A", "long article"]),
    ("<head>\n<meta charset=x><link rel=y>\n<p>x<p>y", ["x", "y"]), ("<head><title>t</title> text <b>b</b>", ["text b"]),
    ("<head><html lang=x><head><base href=y><title>t</title><p>x", ["x"]), ("<head><svg><title>t</title></svg><p>x", ["x"]),
    ("<head><script>a</script><style>b</style><noscript><p>c</p></noscript><template><p>d</template><p>x", ["x"]),
    ("<head><noframes>a<body>b</noframes><title>t</title></head><body>x", ["x"]),
])
def test_a_head_that_is_not_closed_ends_where_it_must(page, want):
    assert texts(page) == want


@pytest.mark.parametrize("page,want", [
    ("<p>a</p><![[foo[ x ]]><p>b</p>", ["a", "b"]), ("<p>a</p><![[[<![ x ><p>b</p>", ["a", "b"]),
    ("<p>a</p><!-- x <p>b</p>", ["a"]), ("a<!--><p>b", ["a", "b"]), ("a<!---><p>b", ["a", "b"]), ("a<!-- x --!><p>b", ["a", "b"]),
    ("<p>a</p><!x <p", ["a"]), ("<p>a</p><?x", ["a"]), ("<p>a</p><a href=\"x", ["a"]), ("<p>a</p></di", ["a"]),
    ("<svg><style>x</svg><p>b</p>", ["b"]), ("<svg><title>t</title><style>x</style><p>b</p>", ["b"]), ("<svg><path><p>b</p>", ["b"]),
    ("<svg><foreignObject><p>x</p></foreignObject></svg><p>b", ["b"]), ("a<svg/>b", ["ab"]), ("a<svg><g/>x</svg>b", ["ab"]),
    ("<head><object><p>x</head><body><p>y</p>", ["x", "y"]), ("<p>a<object><p>b</p>", ["a", "b"]), ("a<template><p>b</p>", ["a", "b"]),
    ("<object><p>x<object>y</object><p>z", ["x", "z"]), ("<object>x</object><p>y", ["y"]),
])
def test_what_has_no_end(page, want):
    assert texts(page) == want


@pytest.mark.parametrize("page,want", [
    ("<p>a&#" + "1" * 5000 + ";b</p>", ["a\ufffdb"]), ("<p>a&#" + "0" * 5000 + "65;b</p>", ["aAb"]), ("a&#" + "0" * 5000 + " b", ["a\ufffd b"]),
    ("<p class='&#" + "9" * 5000 + "'>x", ["x"]), ("<p>&#" + "9" * 5000, ["\ufffd"]), ("<script>&#" + "9" * 5000 + "</script>x", ["x"]),
])
def test_references_of_any_length_are_read(page, want):
    assert texts(page) == want


def test_pages_with_bytes_that_are_no_utf8(spark, field):
    article = b"<article><h1>Head</h1><p>Some words of an arti\xffcle that goes on and on, with a stop at the end of it.</p></article>"
    pages = spark.createDataFrame([(1, bytearray(article)), (2, bytearray(article.replace(b"\xff", b"")))], "page_id int, html binary")
    rows = M.extracted(pages.selectExpr("page_id", "CAST(html AS string) AS html"), field=field).select("page_id", "text").collect()
    found = {r["page_id"]: r["text"] for r in rows}
    assert "article that" in found[2] and found[1] == found[2].replace("article", "arti\ufffdcle")


@pytest.mark.parametrize("page,n", [
    ("<div>x" * 50_000, 50_000), ("<div>" * 50_000 + "<p>x</section></i></td>" * 50_000, 50_000),
    ("<i><div>" + "<b>" * 50_000 + "</i>" * 50_000 + "x", 1), ("<svg><foreignobject>" + "<object>" * 50_000 + "<b>" * 50_000 + "x", 1),
    ("<div class='ad menu'><a>x" * 50_000, 50_000), ("<svg>" * 50_000 + "</svg>" * 50_000 + "x", 1),
])
def test_deep_pages_are_read_in_linear_time(page, n):
    started = time.monotonic()
    assert len(texts(page)) == n
    assert time.monotonic() - started < 5


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<![", "<![[", "[", "]]>", "<svg>", "</svg>", "<title>", "<style>", "<object>", "</object>", "<svg/>", "<!--", "-->", "<", ">", "&", "&#x", "&amp;",
                                 "<script>", "</script>", "<a href=\"", "'", "x", " ", "\n", "<li>", "<table>", "</td>", "<?", "é"]), max_size=30))
def test_any_markup_is_read(parts):
    for b in blocks("".join(parts)):
        assert b.text == " ".join(b.text.split()) != ""


def test_composed_pages_have_their_blocks():
    for page, labels in labelled_pages(60, seed=4):
        assert len(blocks(page)) == len(labels)


def test_held_out_pages(field):
    right = whole = total = 0
    pages = labelled_pages(200, seed=77)
    for page, labels in pages:
        got = field.decode(features(blocks(page)))
        hits = sum(a == b for a, b in zip(got, labels))
        right, total, whole = right + hits, total + len(labels), whole + (hits == len(labels))
    assert right / total > 0.99 and whole / len(pages) > 0.93


def test_viterbi_is_the_best_labelling():
    r = np.random.default_rng(0)
    names = [f"f{i}" for i in range(6)]
    f = M.Field({n: tuple(r.normal(size=2)) for n in names}, r.normal(size=(2, 2)).tolist())
    for length in range(1, 8):
        page = [[n for n in names if r.random() < 0.5] for _ in range(length)]

        def score(labels, page=page):
            s = sum(f.weights[n][y] for y, block in zip(labels, page) for n in block)
            return s + sum(f.pairs[a][b] for a, b in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=length), key=score)
        assert score(f.decode(page)) == pytest.approx(score(best))


def test_training_raises_the_likelihood():
    pages = [(features(blocks(p)), [int(x) for x in y]) for p, y in labelled_pages(20, seed=8)]

    def likelihood(f):
        total = 0.0
        for found, labels in pages:
            unary = np.array([[sum(f.weights[n][k] for n in block) for k in (0, 1)] for block in found])
            pair, ahead = np.array(f.pairs), unary[0]
            for u in unary[1:]:
                ahead = np.logaddexp(ahead[0] + pair[0], ahead[1] + pair[1]) + u
            own = sum(unary[i, y] for i, y in enumerate(labels)) + sum(pair[a, b] for a, b in zip(labels, labels[1:]))
            total += own - np.logaddexp(*ahead)
        return total

    assert likelihood(M.train(pages, rounds=5)) < likelihood(M.train(pages, rounds=60)) < 0


def test_given_pages(spark, field):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = M.extracted(pages.withColumn("text", pages.url), field=field)
    assert sorted(out.columns) == sorted([*pages.columns, "text"])
    for r in out.collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        parts = re.split(r"</?(?:p|h1)>", inner)
        want = [" ".join(references.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in parts]
        assert r.text == "\n".join(x for x in want if x)


def test_odd_rows(spark, field):
    rows = [(1, None), (1, None), (None, ""), (2, "<p></p>"), (3, "<article>" + "<p>Some words here.</p>" * 3000 + "</article>")]
    out = M.extracted(spark.createDataFrame(rows, "page_id int, html string"), field=field)
    found = {r.page_id: r.text for r in out.collect()}
    assert out.count() == 5 and found[1] == found[None] == found[2] == ""
    assert found[3].count("\n") > 2900
    assert M.extracted(spark.createDataFrame([], "page_id int, html string"), field=field).count() == 0


def test_field_from_a_table(spark):
    made = [(p, "\n".join(b.text for b, y in zip(blocks(p), labels) if y)) for p, labels in labelled_pages(60, seed=3)]
    field = M.field_from(spark.createDataFrame(made, "html string, text string").repartition(3))
    right = total = 0
    for page, labels in labelled_pages(40, seed=5):
        got = field.decode(features(blocks(page)))
        right, total = right + sum(a == b for a, b in zip(got, labels)), total + len(labels)
    assert right / total > 0.97
