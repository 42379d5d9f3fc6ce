import pytest

from labelmill.llm import chat_pairs as C

SCHEMA = "conv_id int, turn int, role string, text string, prompt string, n int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello there"), (1, 2, "user", "more"), (1, 3, "assistant", "yes"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "hello there"), (2, 2, "user", "other"), (2, 3, "assistant", "no"),
    (3, 0, "user", "hi"), (4, 0, "user", None), (4, 1, None, "x"), (5, None, "user", "q"), (5, 1, "assistant", "<|end|> a\U0001f600"),
    (6, 0, "user", "q"), (6, 1, "assistant", ""), (7, 0, "user", "q"), (7, 1, "assistant", ""), (7, 1, "assistant", ""),
    (None, 0, "user", "hi"), (8, 0, "assistant", "x" * 50_000),
]


def by_hand(rows):
    convs = {}
    for c, t, role, text in set(rows):
        if c is not None:
            convs.setdefault(c, []).append((t, role, text))
    key = lambda t: tuple((x is not None, x if x is not None else 0 if i == 0 else "") for i, x in enumerate(t))
    convs = {c: sorted(t, key=key) for c, t in convs.items()}
    said = lambda c: sum(len(x or "") for _, r, x in convs[c] if r == "assistant")
    groups = {}
    for c, t in convs.items():
        groups.setdefault(t[0][1:], []).append(c)
    pairs = []
    for members in groups.values():
        members.sort(key=lambda c: (-said(c), c))
        pairs += [("opening", a, b, convs[a], convs[b]) for a, b in zip(members, members[1:])]
    for c, t in convs.items():
        own = [x for _, r, x in t if r == "assistant"]
        if t[-1][1] == "assistant" and len(own) >= 2:
            pairs.append(("stale", c, c, t, [*t[:-1], (t[-1][0], "assistant", own[-2])]))
    plain = lambda s: (s or "").replace("<|", "< |")

    def shown(turns):
        out, spans = "", []
        for _, role, text in turns:
            out += f"<|{plain(role)}|>\n"
            if role == "assistant":
                spans.append((len(out), len(out) + len(plain(text)) + 7))
            out += plain(text) + "<|end|>\n"
        return out, spans

    made = []
    for kind, a, b, x, y in pairs:
        n = 0
        while n < min(len(x), len(y)) and x[n][1:] == y[n][1:]:
            n += 1
        (c, cm), (r, rm) = shown(x[n:]), shown(y[n:])
        made.append((kind, a, b, n, shown(x[:n])[0], c, r, cm, rm, bool(c and r and c != r)))
    return sorted(made, key=str)


def got(frame):
    spans = lambda m: [(s.start, s.end) for s in m]
    return sorted([
        (r.kind, r.chosen_id, r.rejected_id, r.n_prompt_turns, r.prompt, r.chosen, r.rejected, spans(r.chosen_mask),
         spans(r.rejected_mask), r.usable) for r in frame.collect()
    ], key=str)


def test_pairs(spark):
    assert got(C.preference_pairs(table(spark, ROWS))) == by_hand(ROWS)


def test_prompt_and_completion_give_the_conversation_back(spark):
    for kind, a, b, n, prompt, chosen, *_ in got(C.preference_pairs(table(spark, ROWS))):
        if a == 1:
            assert prompt + chosen == "<|user|>\nhi<|end|>\n<|assistant|>\nhello there<|end|>\n<|user|>\nmore<|end|>\n<|assistant|>\nyes<|end|>\n"


def test_empty_table(spark):
    assert C.preference_pairs(table(spark, [])).count() == 0


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_a_common_opening_gives_one_pair_less_than_it_has_members(spark, monkeypatch, broadcast):
    monkeypatch.setattr(C, "BROADCAST_ROWS", broadcast)
    rows = [r for c in range(300) for r in ((c, 0, "user", "hi"), (c, 1, "assistant", "a" * (c % 17)))]
    convs = C.conversations(table(spark, rows))
    pairs = C.pairs_by_first_turn(convs, group=50).select("chosen_id", "rejected_id").collect()
    assert len(pairs) == 299
    assert len({p.chosen_id for p in pairs}) == len(pairs) == len({p.rejected_id for p in pairs})


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_a_common_opening_keeps_every_pair_over_many_ranges(spark, monkeypatch, broadcast):
    monkeypatch.setattr(C, "BROADCAST_ROWS", broadcast)
    rows = [r for c in range(400) for r in (
        (c, 0, "user", "hi" if c % 4 else "ho" if c % 8 else f"own {c % 3}"), (c, 1, "assistant", "a" * (c % 7)))]
    pairs = [(p[1], p[2]) for p in by_hand(rows) if p[0] == "opening"]
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "9"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for group in (0, 45, 1000):
            convs = C.conversations(table(spark, rows))
            found = C.pairs_by_first_turn(convs, group=group).select("chosen_id", "rejected_id").collect()
            assert sorted(map(tuple, found)) == sorted(pairs)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
