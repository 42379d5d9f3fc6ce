"""The stages against plain Python, and the registered queries' shape."""

from collections import Counter

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from labelmill.llm import packing as P
from tests.llm.cases import documents, none, prose
from tests.llm.test_decontaminate import by_hand as contaminated
from tests.llm.test_packing import check
from tests.llm.test_quality import by_hand as measures
from tests.llm.test_quality import failures
from tests.llm.test_simhash import groups_by_hand, near_copies, print_by_hand

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    passage = " ".join(items[0][1].split()[:15])
    found = [prose(i, 80) for i in range(30)] + near_copies(8, seed=70) + [
        prose(90, 70) + " " + passage + " " + prose(91, 30), prose(92, 60) + " mail to a.b@mail.example.com now",
        "short", "", None, "again and " * 60, prose(93, 4000),
    ]
    docs = documents(spark, list(enumerate(found)) + [(0, found[0])])
    rows = [r for r in docs.collect() if not any(failures(measures(r.text)))]
    root = groups_by_hand([print_by_hand(r.text) for r in rows])
    best = {}
    for r, g in zip(rows, root):
        best[g] = min(best.get(g, r.doc_id), r.doc_id)
    kept = {i: found[i] for i in best.values()}
    kept = {i: t for i, t in kept.items() if not contaminated(t, items)[1]}
    frame, stages = docs, corpus_pipeline.STAGES
    for name, stage in stages[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == docs.columns, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}-{np.random.randint(1 << 60)}"
        frame.write.parquet(path)
        frame = spark.read.parquet(path)
    out = {r.doc_id: r for r in frame.collect()}
    assert set(out) == set(kept) and frame.count() == len(kept)
    assert 30 <= len(kept) < len(rows)
    changed = {i for i in kept if out[i].text != kept[i]}
    assert changed == {i for i, t in kept.items() if "@" in t} and len(changed) == 1
    used, least = check(frame, stages[-1][1](spark, frame, SF), P.LENGTH)
    assert used <= least + 1


def test_empty_documents(spark):
    frame = none(spark)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF)
        assert frame.count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len(rows) > 50 and all(r.length > 0 for r in rows)
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= P.LENGTH and len(fill) <= -(-sum(fill.values()) // P.LENGTH) + 1


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
