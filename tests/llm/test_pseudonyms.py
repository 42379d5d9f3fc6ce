import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from labelmill.llm import pseudonyms as P
from tests.llm.cases import documents, none, texts

KEY = "test"


def fresh(spark, found, key=KEY):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(found)], "doc_id int, text string").coalesce(2)
    return [r.text for r in P.pseudonymised(df, key).orderBy("doc_id").collect()]


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])


VALID = [
    "4539578763621486", "4539 5787 6362 1486", "jo.Ann-3@mail4.example.com", "106.158.249.239", "1987-03-09", "2000-02-29",
    "31/12/2000", "12/31/2000", "9.3.1987", "123-45-6789", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432",
    "+1 (183) 555-1276", "+15455559193", "(212) 555-0199", "212-555-0199", "+49 30 1234567",
]
INVALID = [
    "4539578763621487", "300.1.1.1", "1.2.3.4.5", "2021-02-30", "1850-01-01", "13/31/2000", "000-12-3456", "666-45-6789",
    "DE88 3704 0044 0532 0130 00", "42", "1234", "a1b2", "12345678901234567890123", "x@y", "v1.2.3", "2024", "10:30",
]


def test_valid_values_change_and_stay_valid(spark):
    got = fresh(spark, [f"so {v}, then" for v in VALID])
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s)))
    for v, out in zip(VALID, got):
        new = re.fullmatch(r"so (.*), then", out)[1]
        assert new != v, v
        if not re.fullmatch(r"9\.3\.1987|106.*", v):
            assert shape(new.split("@")[0]) == shape(v.split("@")[0]), (v, new)
        if v.startswith("4539"):
            assert luhn(new) % 10 == 0
        if "@" in v:
            assert new.endswith("@mail4.example.com")
        if v.startswith("106"):
            assert all(0 <= int(x) <= 255 for x in new.split("."))
        if re.fullmatch(r"\d{4}-\d\d-\d\d", v):
            assert date.fromisoformat(new).year == int(v[:4])
    assert re.sub(r"\D", "", got[0]) == re.sub(r"\D", "", got[1])  # the same card, written twice


BEHIND = [
    ("{} 12 May", "ES9121000418450200051332"), ("{} IN the", "BE68 5390 0754 7034"), ("{} 2024 12 A", "AT61 1904 3002 3457 3201"),
    ("ID12 {}", "4111 1111 1111 1111"), ("AB12 1234 5678 {}", "106.158.249.239"), ("AB12 1234 5678 {}", "1987-03-09"),
    ("4539 {}", "4111 1111 1111 1111"), ("{} 1234 5678", "+1 212 555 0199"), ("+49 30 {}", "4111 1111 1111 1111"),
    ("+49 30 {} 1234", "4111 1111 1111 1111"), ("{} 2024", "+49 30 1234567 8901"),
]


def test_a_value_beside_what_looks_like_more_of_it(spark):
    alone = fresh(spark, [v for _, v in BEHIND])
    assert all(a != v for (_, v), a in zip(BEHIND, alone))
    got = fresh(spark, [f"so {around.format(v)}, then" for around, v in BEHIND])
    for (around, v), a, out in zip(BEHIND, alone, got):
        assert v not in out, (around, v)
        if not v.startswith("+"):
            assert out == f"so {around.format(a)}, then"


def test_values_one_after_the_other(spark):
    values = ["4111 1111 1111 1111", "+1 212 555 0199", "2024-01-05", "106.158.249.239", "ES91 2100 0418 4502 0005 1332"]
    orders = [(1, 0, 1), (1, 2, 1), (1, 3), (4, 4, 2), (4, 0, 4), (0, 0, 1)]
    got = fresh(spark, values + [" ".join(values[i] for i in o) for o in orders])
    for o, out in zip(orders, got[len(values):]):
        assert out == " ".join(got[i] for i in o)


def test_invalid_and_plain_texts_stay(spark):
    plain = [f"so {v} then" for v in INVALID] + [t for t in texts() if t is not None]
    assert fresh(spark, plain) == plain
    assert fresh(spark, [None, ""]) == [None, ""]


def test_equal_values_stay_linked_and_the_key_decides(spark):
    a, b = fresh(spark, ["x 106.158.249.239", "106.158.249.239 y z"])
    assert a.split()[1] == b.split()[0]
    assert fresh(spark, ["x 106.158.249.239"], "other")[0] != a


def test_counts_and_columns(spark):
    docs = documents(spark, [(1, "a@b.com and 1987-03-09"), (1, "a@b.com and 1987-03-09"), (None, None), (3, "4539578763621487")])
    out = P.pseudonymised(docs, KEY)
    assert set(docs.columns) <= set(out.columns)
    assert sorted(r.n_replaced for r in out.collect()) == [0, 0, 2, 2]
    assert P.pseudonymised(none(spark), KEY).count() == 0
    assert P.pseudonymised(docs, KEY, count=None).columns == docs.columns


@pytest.mark.parametrize("bases", [[10], [10, 10], [5, 73], [2, 3, 4], [26, 10, 2]])
def test_network_is_a_permutation(spark, bases):
    grids = [[]]
    for b in bases:
        grids = [g + [x] for g in grids for x in range(b)]
    df = spark.createDataFrame([(g,) for g in grids], "v array<int>").coalesce(2)
    base = F.array(*[F.lit(b) for b in bases])
    out = {tuple(r.w) for r in df.select(P.feistel(F.col("v"), base, "t", KEY).alias("w")).collect()}
    assert len(out) == len(grids) and all(0 <= x < b for row in out for x, b in zip(row, bases))


def test_days_of_a_year_are_permuted(spark):
    df = spark.sql("SELECT explode(sequence(date'2023-01-01', date'2024-12-31')) AS d").select(F.col("d").cast("string").alias("text"))
    out = [r.text for r in P.pseudonymised(df, KEY).collect()]
    assert len(out) == len(set(out)) == 731 and sum(t.startswith("2024") for t in out) == 366


def test_by_hand(spark):
    """The network, spelled out in Python, on one address."""
    import hashlib

    def network(values, bases, kind):
        half = len(values) // 2
        a, b = list(values[:half]), list(values[half:])
        for r in range(P.ROUNDS):
            other, mine, base = (b, a, bases[:half]) if r % 2 == 0 else (a, b, bases[half:])
            told = ",".join(map(str, other))
            for i in range(len(mine)):
                digest = hashlib.sha256(f"{KEY}|{kind}|{r}|{told}|{i}".encode()).hexdigest()
                mine[i] = (mine[i] + int(digest[:12], 16)) % base[i]
        return a + b

    want = ".".join(map(str, network([106, 158, 249, 239], [256] * 4, "ipv4")))
    assert fresh(spark, ["106.158.249.239"]) == [want]
