import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from labelmill.llm import sharding
from tests.llm.cases import documents, none


@pytest.mark.parametrize("n,shards", [(0, 3), (1, 3), (7, 3), (500, 8), (20, 1)])
def test_sizes_and_slots(spark, n, shards):
    rows = sharding.shuffle_into_shards(spark.range(0, n, 1, 5), shards).collect()
    assert sorted(r.id for r in rows) == list(range(n))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_a_shard_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOTS_PER_TASK", 16)
    rows = sharding.shuffle_into_shards(spark.range(0, 700, 1, 4), 2).collect()
    for s in (0, 1):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(350))


def test_odd_rows_and_columns(spark):
    docs = documents(spark)
    out = sharding.shuffle_into_shards(docs, 4)
    assert out.columns == [c for c in docs.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    same = Counter((r.doc_id, r.text) for r in docs.collect())
    assert Counter((r.doc_id, r.text) for r in out.collect()) == same
    assert sharding.shuffle_into_shards(none(spark), 4).count() == 0


def test_draw_is_hypergeometric(spark):
    draw = F.expr(sharding._draw("30L", "12L", "10L", sharding._uniform("id")))
    n = 20_000
    seen = Counter(r.x for r in spark.range(n).select(draw.alias("x")).collect())
    chi = 0.0
    for k in range(1, 9):
        want = n * math.comb(12, k) * math.comb(18, 10 - k) / math.comb(30, 10)
        chi += (seen[k] - want) ** 2 / want
    assert chi < 27  # 8 cells: beyond this in one case of a thousand


def test_draw_at_the_edges(spark):
    for total, marked, drawn, want in ((0, 0, 0, 0), (5, 0, 3, 0), (5, 5, 3, 3), (5, 2, 5, 2), (9, 4, 0, 0)):
        expr = sharding._draw(f"{total}L", f"{marked}L", f"{drawn}L", sharding._uniform("id"))
        assert {r.x for r in spark.range(20).select(F.expr(expr).alias("x")).collect()} == {want}


def test_matrix_keeps_both_margins(spark):
    counts = spark.createDataFrame([(i, 10 + 7 * i) for i in range(11)], "part int, n long")
    sizes = sharding.even_sizes(sum(10 + 7 * i for i in range(11)), 8)
    rows = {r.part: r.sizes for r in sharding.matrix(counts, sizes).collect()}
    assert all(sum(rows[i]) == 10 + 7 * i and min(rows[i]) >= 0 for i in range(11))
    assert [sum(r[j] for r in rows.values()) for j in range(8)] == sizes


def test_positions_do_not_follow_the_input(spark):
    rows = sharding.shuffle_into_shards(spark.range(0, 4000, 1, 4), 4).collect()
    per_part = Counter((r.id // 1000, r.shard) for r in rows)
    assert all(180 < c < 320 for c in per_part.values())
    mean = sum(r.id for r in rows if r.slot < 500) / 2000
    assert abs(mean - 2000) < 150


def test_seed_decides(spark):
    place = lambda seed: {r.id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(spark.range(0, 200, 1, 3), 4, seed).collect()}
    assert place(1) == place(1) != place(2)
