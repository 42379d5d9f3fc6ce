import re
from collections import Counter

from pyspark.sql import functions as F

from labelmill.llm import decontaminate as D
from labelmill.operators import bits
from tests.llm.cases import documents, none, prose, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(text, items, size=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(size, len(b))
        for i in range(len(b) - n + 1 if b else 0):
            for k in range(len(w) - n + 1):
                if w[k : k + n] == b[i : i + n]:
                    hit.update(range(k, k + n))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), sorted(found)


PASSAGE = prose(50, 25)
ITEMS = [
    (1, PASSAGE), (2, prose(51, 4)), (10, "Ünder dem É"), (3, ""), (4, None), (None, prose(52, 12)),
    (5, PASSAGE), (6, "the the the the the the the the the the the"), (6, prose(53, 11)),
]


def corpus():
    p = words(PASSAGE)
    return texts() + [
        "before " + PASSAGE + " after", " ".join(p[3:13]).upper(), " ".join(p[3:12]), PASSAGE + PASSAGE,
        prose(51, 4) + " x " + prose(51, 4), "x Ünder dem É y", prose(52, 12), "the " * 40, prose(4, 2000) + PASSAGE,
    ]


def test_matches_brute_force(spark):
    docs = documents(spark, list(enumerate(corpus())) + [(17, corpus()[17]), (None, PASSAGE)])
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    out = D.contamination(docs, items).collect()
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in out)
    want = Counter()
    for r in docs.collect():
        n, hit, found = by_hand(r.text, ITEMS)
        want[(r.doc_id, n, hit, tuple(found))] += 1
    assert got == want and sum(h for _, _, h, _ in got) > 100


def test_full_bit_tables_change_nothing(spark, monkeypatch):
    docs = documents(spark, list(enumerate(corpus())))
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    rows = lambda: sorted(map(str, D.contamination(docs, items).collect()))
    before = rows()
    monkeypatch.setattr(bits, "BITS", 64)
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    assert rows() == before


def test_empty_sides(spark):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert D.contamination(none(spark), items).count() == 0
    nothing = items.limit(0)
    out = D.contamination(documents(spark), nothing)
    assert out.count() == documents(spark).count() and out.where("n_hit > 0").isEmpty()


def test_filter_keeps_rows_and_columns(spark):
    docs = documents(spark, list(enumerate(corpus())) + [(1, "clean words"), (1, "clean words")])
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    out = D.without_contaminated(docs, items)
    assert out.columns == docs.columns
    want = Counter((r.doc_id, r.text) for r in docs.collect() if not by_hand(r.text, ITEMS)[1])
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want


def test_proximity(spark):
    docs = ["a x b y c", "c b a", "a a a b", "a x x x x b c", "b c x a", "a", None, "c x x b x a"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    phrases = spark.createDataFrame([("a b c",), ("a",)], "phrase string")
    terms = D.phrase_terms(phrases)
    index = D.build_index(df, "doc_id", "text")
    keys = {r.row: r.key for r in index.where("term IS NULL").collect()}
    names = {r.id: r.phrase for r in phrases.select("phrase", F.xxhash64("phrase").alias("id")).collect()}
    for within in (1, 3, 4, 6):
        found = {(keys[r.row], names[r.phrase_id], r.anchor) for r in D.proximity_matches(index, terms, within).collect()}
        got = {(d, p) for d, p, _ in found}
        want = set()
        for d, t in enumerate(docs):
            w = words(t)
            for p in ("a b c", "a"):
                need = set(p.split())
                if any(need <= set(w[i : i + within]) for i in range(len(w))):
                    want.add((d, p))
        assert got == want, within


def test_near_looks_in_one_or_two_ranges(spark, monkeypatch):
    """Every place less than ``within`` away is met once, also at the ends of ranges, and few rows are made for it."""
    made, store = [], D.stored
    monkeypatch.setattr(D, "stored", lambda rows, name: made.append(store(rows, name)) or made[-1])
    index = spark.createDataFrame([(1, p, 7) for p in range(200)] + [(2, 5, 7), (1, 300, None)], "row long, pos int, term long")
    anchors = [0, 1, 3, 4, 15, 16, 17, 19, 20, 40, 79, 80, 81, 120, 199]
    wanted = spark.createDataFrame([(1, a, 0, 7) for a in anchors] + [(3, 5, 0, 7)], "row long, anchor int, phrase_id long, term long")
    for within in (1, 4, 20):
        made.clear()
        found = Counter((r.row, r.anchor, r.pos) for r in D._near(index, wanted, within).collect())
        assert found == Counter((1, a, p) for a in anchors for p in range(200) if abs(a - p) < within)
        assert made[0].count() < 2 * wanted.count()


def test_near_windows_are_counted(spark):
    docs = documents(spark, list(enumerate(corpus())) + [(None, ITEMS[0][1]), (2, None)])
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    phrases = {r.phrase for r in D.windows(items, "item_id", "text").collect()}
    for within in (D.WINDOW, D.NEAR):
        want = []
        for r in docs.collect():
            w = words(r.text)
            near = 0
            for phrase in phrases:
                own = set(phrase.split(" "))
                near += any(own <= set(w[i : i + within]) for i in range(len(w)) if w[i] in own)
            want.append((r.doc_id is None, r.doc_id or 0, len(w), near))
        found = D.contamination(docs, items, near=within).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_near) for r in found) == sorted(want)
        assert sum(x[-1] for x in want) > 0
