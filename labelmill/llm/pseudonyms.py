"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A found value is first validated (Luhn, mod 97, calendar, octet and area ranges); only a valid
one is replaced, by a keyed Feistel permutation of its own format: a card number becomes
another valid card number, a date another day of the same year, an e-mail address another one
of the same shape at the same host (letters beyond ASCII stay). The key and the kind are the only tweak, so equal values get
equal pseudonyms in every document, and two values of one format never share one.

A match is not yet a value. Every place of the text where one starts is tried from left to right: an
IBAN or a phone number that is too long gives its longest valid part up to a separator (a phone
number never ends inside a valid value of another kind), and behind a match that is not valid the
search goes on at the next place, not at the match's end.

A value is a list of digits, each with its own base (10 for a digit, 26 for a letter, 256 for an
octet, 5 x 73 or 6 x 61 for the day of a year). The list is cut in two halves; in each round one
half is moved, digit by digit, by a hash of the key, the round and the other half.

Everything is an expression over the row: no shuffle, no Python. Null texts stay null, empty
texts stay empty, texts without a valid value are returned unchanged to the byte. Repeated rows
are treated alike. Other columns pass through; ``n_replaced`` replaces a column of that name.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: For tests and the registered query only; a real corpus brings its own secret.
DEMO_KEY = "demonstration key"

# What is looked for, in the order in which it is tried at a place in the text.
_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,10}"
IBAN = _EDGE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END
CARD = _EDGE + r"(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})" + _END
SSN = _EDGE + r"\d{3}-\d{2}-\d{4}" + r"(?![\p{L}\p{N}]|-\d)"
IPV4 = r"(?<![\p{L}\p{N}]|\d\.)\d{1,3}(?:\.\d{1,3}){3}(?![\p{L}\p{N}]|\.\d)"
DATE = _EDGE + r"(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}([./-])\d{1,2}\3\d{4})" + _END
PHONE = (
    r"(?:(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}"
    + r"|(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}[ .-]\d{4}|" + _EDGE + r"\d{3}([.-])\d{3}\4\d{4})" + _END
)
ANY = "|".join([EMAIL, IBAN, CARD, SSN, IPV4, DATE, PHONE])
# Every place where a match starts, also inside of another; group 1 is the match.
_AT = "(?=(" + re.sub(r"\\([1-9])", lambda m: f"\\{int(m[1]) + 1}", ANY) + "))"
# Every kind has an at sign or a digit; most texts have neither.
_MAYBE = r"[@0-9]"

# Characters of an IBAN by country; for others mod 97 alone decides.
IBAN_LENGTH = {
    country: int(n) for n, countries in (part.split(":") for part in (
        "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV "
        "22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG "
        "25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV "
        "29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
    ).split()) for country in countries.split(",")
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _whole(pattern: str) -> str:
    """The shape of a match without what must stand around it."""
    for around in (_EDGE, _END, r"(?<![\p{L}\p{N}._%+-])", r"(?![\p{L}\p{N}]|-\d)",
                   r"(?<![\p{L}\p{N}]|\d\.)", r"(?![\p{L}\p{N}]|\.\d)", r"(?<![\p{L}\p{N}+])"):
        pattern = pattern.replace(around, "")
    for old, new in ((r"\3", r"\1"), (r"\4", r"\1")):
        pattern = pattern.replace(old, new)
    return f"^(?:{pattern})$"


def feistel(values: Column, bases: Column, kind: str | Column, key: str) -> Column:
    """A permutation of all digit lists with these ``bases``; both are int arrays of one size.

    Every ``kind`` has its own. The key is a literal of the plan and stands in what ``explain`` and
    event logs show of it, so guard those as the key.
    """
    kind = F.lit(kind) if isinstance(kind, str) else kind

    def moved(digit: Column, base: Column, other: Column, turn: Column, i: Column) -> Column:
        told = F.array_join(F.transform(other, lambda v: v.cast("string")), ",")
        said = F.concat_ws("|", F.lit(key), kind, turn.cast("string"), told, i.cast("string"))
        amount = F.conv(F.substring(F.sha2(said, 256), 1, 12), 16, 10).cast("bigint")
        return F.pmod(digit + amount, base).cast("int")

    def network(v: Column) -> Column:
        half = F.floor(F.size(v) / 2).cast("int")

        def turn(s: Column, r: Column) -> Column:
            left = F.transform(s["a"], lambda d, i: moved(d, F.get(bases, i), s["b"], r, i))
            right = F.transform(s["b"], lambda d, i: moved(d, F.get(bases, half + i), s["a"], r, i))
            even = F.struct(left.alias("a"), s["b"].alias("b"))
            return F.when(r % 2 == 0, even).otherwise(F.struct(s["a"].alias("a"), right.alias("b")))

        start = F.struct(
            F.slice(v, F.lit(1), half).alias("a"), F.slice(v, half + 1, F.size(v) - half).alias("b")
        )
        turns = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
        return F.aggregate(turns, start, turn, lambda s: F.concat(s["a"], s["b"]))

    return _let(values, network)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _varies(c: Column) -> Column:
    return c.rlike("^[A-Za-z0-9]$")


def _first(c: Column) -> Column:
    """Code of the first character of the class of ``c``."""
    return F.when(c.rlike("[0-9]"), 48).when(c.rlike("[A-Z]"), 65).otherwise(97)


def _values(chars: Column) -> tuple[Column, Column]:
    digits = F.transform(chars, lambda c: F.ascii(c) - _first(c))
    return digits, F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), 10).otherwise(26))


def _written(shape: Column, values: Column) -> Column:
    """``shape`` (characters) with its letters and digits replaced in order by ``values``."""

    def one(c: Column, i: Column) -> Column:
        nth = F.size(F.filter(F.slice(shape, F.lit(1), i), _varies))
        return F.when(_varies(c), F.char(F.get(values, nth) + _first(c))).otherwise(c)

    return F.array_join(F.transform(shape, one), "")


def _permuted(text: Column, kind: str, key: str) -> Column:
    """All ASCII letters and digits of ``text`` permuted; everything else stays in place."""

    def body(shape: Column) -> Column:
        def inner(live: Column) -> Column:
            return _written(shape, feistel(*_values(live), kind, key))

        return _let(F.filter(shape, _varies), inner)

    return _let(_chars(text), body)


def _digits(text: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(text, "[^0-9]", "")), lambda c: c.cast("int"))


def luhn_check(payload: Column) -> Column:
    """The check digit that belongs behind a list of digits."""
    doubled = F.transform(
        F.reverse(payload), lambda d, i: F.when(i % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    )
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda a, d: a + d), F.lit(10)).cast("int")


def _card(m: Column, key: str) -> Column:
    def body(d: Column) -> Column:
        payload, last = F.slice(d, F.lit(1), F.size(d) - 1), F.element_at(d, -1)
        tens = F.transform(payload, lambda _: F.lit(10))
        fresh = _let(feistel(payload, tens, "card", key), lambda p: F.concat(p, F.array(luhn_check(p))))
        written = _let(_chars(m), lambda shape: _let(fresh, lambda v: _written(shape, v)))
        return F.when(luhn_check(payload) == last, written).otherwise(m)

    return _let(_digits(m), body)


def mod97(text: Column) -> Column:
    """The number that letters and digits spell (A is 10), modulo 97."""

    def step(a: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        value = F.ascii(c) - F.when(digit, 48).otherwise(55)
        return F.pmod(a * F.when(digit, 10).otherwise(100) + value, F.lit(97)).cast("int")

    return F.aggregate(_chars(text), F.lit(0), step)


def _longest(m: Column, mark: str, valid: Callable[[Column], Column]) -> Column:
    """The longest valid part of ``m`` from its start to a ``mark`` or its end; else null."""
    ends = F.filter(
        F.sequence(F.length(m), F.lit(1), F.lit(-1)),
        lambda i: (i == F.length(m)) | F.substr(m, i + 1, F.lit(1)).rlike(mark),
    )
    return F.get(F.filter(F.transform(ends, lambda i: F.substr(m, F.lit(1), i)), valid), F.lit(0))


def _iban_valid(m: Column) -> Column:
    def body(s: Column) -> Column:
        lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTH.items() for x in pair])
        n = F.coalesce(F.try_element_at(lengths, F.substring(s, 1, 2)), F.length(s))
        right = (F.length(s) == n) & (F.length(s) >= 12)
        return right & (mod97(F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))) == 1)

    return _let(F.regexp_replace(m, " ", ""), body)


def _iban(m: Column, key: str) -> Column:
    valid = _iban_valid(m)

    def body(s: Column) -> Column:
        country, rest = F.substring(s, 1, 2), F.substring(s, 5, 40)

        def fresh(r: Column) -> Column:
            check = F.lpad((98 - mod97(F.concat(r, country, F.lit("00")))).cast("string"), 2, "0")
            whole = F.concat(country, check, r)
            return _let(_chars(m), lambda shape: _spelled(shape, whole))

        return F.when(valid, _let(_permuted(rest, "iban", key), fresh)).otherwise(m)

    return _let(F.regexp_replace(m, " ", ""), body)


def _spelled(shape: Column, whole: Column) -> Column:
    """The characters of ``whole`` in the places of ``shape`` that are not spaces."""

    def one(c: Column, i: Column) -> Column:
        nth = F.size(F.filter(F.slice(shape, F.lit(1), i), lambda x: x != " "))
        return F.when(c != " ", F.substr(whole, nth + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(shape, one), "")


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups from 01, serials from 0001."""

    def body(p: Column) -> Column:
        area, group, serial = (F.get(p, F.lit(i)) for i in range(3))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        values = F.array(area - 1 - F.when(area > 666, 1).otherwise(0), group - 1, serial - 1)
        bases = F.array(F.lit(898), F.lit(99), F.lit(9999))

        def written(v: Column) -> Column:
            a = F.get(v, F.lit(0)) + 1
            a = a + F.when(a >= 666, 1).otherwise(0)
            parts = [(a, 3), (F.get(v, F.lit(1)) + 1, 2), (F.get(v, F.lit(2)) + 1, 4)]
            return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in parts])

        return F.when(valid, _let(feistel(values, bases, "ssn", key), written)).otherwise(m)

    return _let(F.transform(F.split(m, "-"), lambda x: x.cast("int")), body)


def _ipv4(m: Column, key: str) -> Column:
    def body(p: Column) -> Column:
        bases = F.transform(p, lambda _: F.lit(256))
        fresh = F.transform(feistel(p, bases, "ipv4", key), lambda v: v.cast("string"))
        return F.when(F.forall(p, lambda x: x <= 255), F.array_join(fresh, ".")).otherwise(m)

    return _let(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), body)


def _date(m: Column, key: str) -> Column:
    """Another day of the same year. Day before month where both readings are dates."""
    parts = F.split(m, "[./-]")

    def body(p: Column) -> Column:
        first, second, third = (F.get(p, F.lit(i)) for i in range(3))
        mark = F.regexp_extract(m, "[./-]", 0)
        iso = F.length(first) == 4
        year = F.when(iso, first).otherwise(third)

        def day(month: Column, day_of: Column) -> Column:
            return F.try_to_timestamp(F.concat_ws("-", year, month, day_of), F.lit("yyyy-M-d")).cast("date")

        as_iso, as_dm, as_md = day(second, third), day(second, first), day(first, second)
        day_first = as_dm.isNotNull()
        date = F.when(iso, as_iso).otherwise(F.coalesce(as_dm, as_md))

        def moved(d: Column) -> Column:
            start = F.trunc(d, "year")
            days = F.datediff(F.add_months(start, 12), start)
            step = F.when(days == 366, 61).otherwise(73)
            at = F.datediff(d, start)
            values = F.array(F.floor(at / step).cast("int"), F.pmod(at, step).cast("int"))
            bases = F.array((days / step).cast("int"), step)
            # Every round hashes the year: years do not share one pattern.
            fresh = feistel(values, bases, F.concat(F.lit("date"), F.year(d).cast("string")), key)
            return F.date_add(start, F.get(fresh, F.lit(0)) * step + F.get(fresh, F.lit(1)))

        def padded(number: Column, like: Column) -> Column:
            s = number.cast("string")
            return F.when(F.length(like) > F.length(s), F.lpad(s, 2, "0")).otherwise(s)

        def written(n: Column) -> Column:
            month, of = F.month(n), F.dayofmonth(n)
            a = F.when(iso, year).when(day_first, padded(of, first)).otherwise(padded(month, first))
            b = F.when(~iso & ~day_first, padded(of, second)).otherwise(padded(month, second))
            c = F.when(iso, padded(of, third)).otherwise(year)
            return F.concat(a, mark, b, mark, c)

        known = date.isNotNull() & year.cast("int").between(1900, 2099)
        return F.when(known, _let(_let(date, moved), written)).otherwise(m)

    return _let(parts, body)


def _phone_parts(m: Column) -> tuple[Column, Column]:
    code = F.regexp_extract(m, r"^(\+1|\+\d{1,3}(?=[ .(-])|\+|)", 1)
    return code, F.substr(m, F.length(code) + 1)


def _phone_valid(m: Column) -> Column:
    return F.length(F.regexp_replace(_phone_parts(m)[1], "[^0-9]", "")).between(7, 14)


def _phone(m: Column, key: str) -> Column:
    """The country code stays; the number behind it has 7 to 14 digits."""
    code, rest = _phone_parts(m)
    return F.when(_phone_valid(m), F.concat(code, _permuted(rest, "phone", key))).otherwise(m)


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(_permuted(local, "email", key), F.substr(m, F.length(local) + 1))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of :data:`ANY`; the match itself if it is not valid."""
    return (
        F.when(F.contains(m, F.lit("@")), _email(m, key))
        .when(m.rlike("^[A-Z]"), _iban(m, key))
        .when(m.rlike(_whole(CARD)), _card(m, key))
        .when(m.rlike(_whole(SSN)), _ssn(m, key))
        .when(m.rlike(_whole(IPV4)), _ipv4(m, key))
        .when(m.rlike(_whole(DATE)), _date(m, key))
        .otherwise(_phone(m, key))
    )


def _is_phone(m: Column) -> Column:
    return m.rlike(r"^\+[^@]+$")


def _judged(m: Column, key: str) -> Column:
    """``(value, fresh)`` of a match: what of it is the value, and its pseudonym; equal if not valid.

    Phone numbers with a country code wait for :func:`_with_phones`.
    """
    value = F.when(m.rlike("^[A-Z][^@]+$"), F.coalesce(_longest(m, " ", _iban_valid), m)).otherwise(m)
    made = _let(value, lambda v: F.struct(v.alias("value"), pseudonym(v, key).alias("fresh")))
    return F.when(_is_phone(m), F.struct(m.alias("value"), m.alias("fresh"))).otherwise(made)


def _with_phones(rows: Column, key: str) -> Column:
    """``rows(piece, found)`` with the phone numbers that do not end inside another valid value."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def inside(x: Column, i: Column) -> Column:
        start = F.struct(F.length(x["piece"]).alias("at"), none.alias("spans"))

        def step(a: Column, y: Column) -> Column:
            value, new = y["found"]["value"], y["found"]["fresh"]
            span = F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(value)).alias("end")))
            spans = F.when(value != new, F.concat(a["spans"], span)).otherwise(a["spans"])
            return F.struct((a["at"] + F.length(y["piece"])).alias("at"), spans.alias("spans"))

        # A phone number has at most 35 characters, and two starts have a character between them.
        return F.aggregate(F.slice(rows, i + 2, 18), start, step, lambda a: a["spans"])

    def one(x: Column, i: Column) -> Column:
        m = x["found"]["value"]

        def phone(spans: Column) -> Column:
            def whole(part: Column) -> Column:
                n = F.length(part)
                return _phone_valid(part) & ~F.exists(spans, lambda s: (s["start"] < n) & (n < s["end"]))

            def judged(v: Column) -> Column:
                return F.struct(
                    F.coalesce(v, m).alias("value"), F.coalesce(_phone(v, key), m).alias("fresh")
                )

            return F.struct(x["piece"].alias("piece"), _let(_longest(m, "[ .-]", whole), judged).alias("found"))

        return F.when(_is_phone(m), _let(inside(x, i), phone)).otherwise(x)

    return F.transform(rows, one)


def _replaced(rows: Column) -> Column:
    """``(at, end, out, n)`` of a text in pieces that each start with the value of ``found``.

    A value is replaced if it is valid and starts behind the last one that was replaced.
    """
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("end"), none.alias("out"), F.lit(0).cast("bigint").alias("n"))

    def step(a: Column, x: Column) -> Column:
        value, new = x["found"]["value"], x["found"]["fresh"]
        taken = F.coalesce((a["at"] >= a["end"]) & (value != new), F.lit(False))

        def piece(end: Column) -> Column:
            kept = F.substr(x["piece"], F.greatest(end - a["at"], F.lit(0)) + 1)
            out = F.concat(a["out"], F.array(F.concat(F.when(taken, new).otherwise(""), kept)))
            return F.struct(
                (a["at"] + F.length(x["piece"])).alias("at"), end.alias("end"), out.alias("out"),
                (a["n"] + taken.cast("bigint")).alias("n"),
            )

        return _let(F.when(taken, a["at"] + F.length(value)).otherwise(a["end"]), piece)

    return F.aggregate(rows, start, step)


def pseudonymised(docs: DataFrame, key: str, text: str = "text", count: str | None = "n_replaced") -> DataFrame:
    """``docs`` with valid values in ``text`` replaced, and how many (unless ``count`` is None)."""
    t = F.col(text)
    none = F.array().cast("array<string>")
    found = F.when(t.rlike(_MAYBE), F.regexp_extract_all(t, F.lit(_AT), F.lit(1))).otherwise(none)
    rows = docs.withColumn("__pii_found", F.coalesce(found, none))

    rows = rows.withColumn("__pii_fresh", F.transform("__pii_found", lambda m: _judged(m, key)))
    pieces = F.split(t, _AT, -1)
    # A text that does not start with a match has a piece before the first.
    before = F.slice(F.array(F.lit(None).cast("struct<value:string,fresh:string>")), F.lit(1), F.size(pieces) - F.size("__pii_found"))
    judged = F.arrays_zip(pieces.alias("piece"), F.concat(before, F.col("__pii_fresh")).alias("found"))
    made = _let(judged, lambda p: _let(_with_phones(p, key), _replaced))
    rows = rows.withColumn("__pii_made", F.when(F.size("__pii_found") > 0, made))
    out = {text: F.when(F.size("__pii_found") > 0, F.array_join("__pii_made.out", "")).otherwise(t)}
    if count:
        out[count] = F.coalesce("__pii_made.n", F.lit(0).cast("bigint"))
    return rows.withColumns(out).drop("__pii_found", "__pii_fresh", "__pii_made")
