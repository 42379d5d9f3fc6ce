import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelmill.llm import fill_in_middle as M
from tests.llm.cases import documents, none, prose, texts

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(text, key):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list(" \t\n\x0b\x0c\r\x1c\x85 ab<PSM>é漢\U0001f600")), max_size=60), st.integers(0, 400))
def test_any_text(text, key):
    assert tuple(M.rearranged(text, key)) == by_hand(text, key)


def test_every_rank_is_reached():
    for n in (0, 1, 7, 8, 9, 64, 1000):
        ends = np.cumsum(np.random.default_rng(n).integers(1, 9, n))
        units = M.UnitList(ends)
        assert [units.chars_before(i) for i in range(n + 1)] == [0, *ends.tolist()]
        with pytest.raises(IndexError):
            units.chars_before(n + 1)


def test_lanes_carry_widths():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 9, 50_000))
    units = M.UnitList(ends)
    assert 4 <= len(units.lanes) <= 9
    for low, high in zip(units.lanes, units.lanes[1:]):
        assert len(low.units) / 16 < len(high.units) < len(low.units) / 4 or len(low.units) < 200
    steps = []
    for rank in range(0, 50_001, 997):  # links passed on the way: a few a lane, not the rank
        at, seen = 0, 0
        for level in range(len(units.lanes) - 1, -1, -1):
            lane, done = units.lanes[level], 0
            while at < len(lane.units) and seen + lane.units[at] <= rank:
                seen, at, done = seen + lane.units[at], at + 1, done + 1
            steps.append(done)
            at = lane.below[at] if level else at
    assert max(steps) < 200 and np.mean(steps) < 12


def test_table(spark):
    rows = [(i, t) for i, t in enumerate(texts() * 3)] + [(900, "a <P> b"), (901, prose(7, 400)), (0, "again"), (None, "x y"), (None, None)]
    out = M.fill_in_middle(documents(spark, rows)).withColumn("back", M.restored())
    assert sorted(c for c in out.columns if c != "back") == sorted([*documents(spark, rows).columns, "n", "form", "prefix_chars", "middle_chars", "output"])
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.collect()), key=repr)
    want = sorted(((k, *by_hand(t, k), t or "") for k, t in rows), key=repr)
    assert got == want
    assert {g[2] for g in got} == {"plain", "spm", "psm"}
    assert M.fill_in_middle(none(spark)).count() == 0


def test_names_like_results_are_replaced(spark):
    docs = spark.createDataFrame([(5, "a b c", "x", "y")], "doc_id long, text string, output string, N string")
    row = M.fill_in_middle(docs).first()
    assert row.n == 3 and row.output != "x" and len(row) == 7


def test_all_and_none_changed(spark):
    docs = spark.createDataFrame([(i, "some words of a text") for i in range(30)], "doc_id long, text string")
    forms = {r.form for r in M.fill_in_middle(docs, changed=100, suffix_first=0).collect()}
    assert forms == {"psm"}
    assert {r.form for r in M.fill_in_middle(docs, changed=0).collect()} == {"plain"}
