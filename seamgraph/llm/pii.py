"""PII: format-preserving Feistel pseudonyms for validated numbers, dates and addresses.

A value is found by its kind's pattern, validated (check digit, calendar, ranges) and put through a keyed
Feistel network over its own format, so the pseudonym is a valid value of the same kind, equal values get
equal pseudonyms in every document, and different values get different ones. Texts of digits and letters
are halves whose characters move within their class (digit, leading digit 2-9, lower, upper case); dates are
days of a 400-year cycle, 189 x 773 of them, and addresses of the internet 65536 x 65536.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, packed

ROUNDS = 8
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: kind: pattern. At one place the first kind that matches wins. None of them holds a capturing group.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "date": r"(?<![\d/.-])(?:\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}|\d\d\.\d\d\.\d{4})(?![\d/-]|\.\d)",
    "phone": r"(?<![\d+])(?:\+1[ .-]?|1[ .-])?\([2-9]\d\d\)[ .-]?[2-9]\d\d[ .-]\d{4}(?!\d)"
    r"|(?<![\d+.-])(?:\+1[ .-])?[2-9]\d\d[.-][2-9]\d\d[.-]\d{4}(?![\d.-])"
    r"|(?<![\d+])\+(?!1[ .-]?\(?[2-9])\d{1,3}(?:[ .-]\(?\d{2,4}\)?){2,4}(?!\d)",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])",
    # a run of digits by itself, or the groups that cards are printed in
    "card": r"(?<!\d)\d{13,19}(?!\d)|(?<!\d)(?<!\d[ -])\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})?(?![ -]?\d)"
    r"|(?<!\d)(?<!\d[ -])\d{4}[ -]\d{6}[ -]\d{4,5}(?![ -]?\d)",
}
ANY = "|".join(PATTERNS.values())


def _digest(key: Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", key, *parts), 512)


def _number(hexes: Column, at: Column, n: int) -> Column:
    return F.conv(F.substr(hexes, at, F.lit(n)), 16, 10).cast("long")


def _moved(half: Column, mask: Column, hexes: Column) -> Column:
    """half with each character moved within its class; mask marks with n the digits that stay in 2-9."""

    def char(i: Column) -> Column:
        c = F.ascii(F.substr(half, i, F.lit(1)))
        by = _number(hexes, F.pmod(i - 1, F.lit(32)) * 4 + 1, 4)
        turn = lambda low, n: F.chr((F.pmod(c - low + by, F.lit(n)) + low).cast("long"))
        leading = F.substr(mask, i, F.lit(1)) == "n"
        return (
            F.when(leading, turn(50, 8)).when(c.between(48, 57), turn(48, 10)).when(c.between(97, 122), turn(97, 26))
            .when(c.between(65, 90), turn(65, 26)).otherwise(F.substr(half, i, F.lit(1)))
        )

    return F.when(F.length(half) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), char), ""))


def permuted_text(value: Column, mask: Column, key: Column, kind: str) -> Column:
    """value's letters and digits permuted under key; mask is as long as value."""
    cut = F.floor(F.length(value) / 2).cast("int")
    left = lambda s: F.substr(s, F.lit(1), cut)
    right = lambda s: F.substr(s, cut + 1, F.length(value))
    zero = F.struct(left(value).alias("l"), right(value).alias("r"), left(mask).alias("m"), right(mask).alias("k"))

    def step(a: Column, i: Column) -> Column:
        hexes = _digest(key, F.lit(kind), i.cast("string"), F.length(a["l"]).cast("string"), a["r"])
        return F.struct(a["r"].alias("l"), _moved(a["l"], a["m"], hexes).alias("r"), a["k"].alias("m"), a["m"].alias("k"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), zero, step, lambda a: F.concat(a["l"], a["r"]))


def permuted_number(value: Column, a: int, b: int, key: Column, kind: str) -> Column:
    """A number below a * b permuted under key."""
    zero = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, F.lit(b)).cast("long").alias("r"))

    def step(x: Column, i: Column) -> Column:
        add = _number(_digest(key, F.lit(kind), i.cast("string"), x["r"].cast("string")), F.lit(1), 12)
        size = F.when(i % 2 == 0, F.lit(a)).otherwise(F.lit(b))
        return F.struct(x["r"].alias("l"), F.pmod(x["l"] + add, size).cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), zero, step, lambda x: x["l"] * b + x["r"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _dressed(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced by digits, in turn."""

    def char(i: Column) -> Column:
        c = F.substr(shape, i, F.lit(1))
        return F.when(c.between("0", "9"), F.substr(digits, F.length(_digits(F.substr(shape, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), char), "")


def luhn_sum(digits: Column, double_last: bool) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.ascii(F.substr(digits, i, F.lit(1))) - 48
        twice = F.when((n - i) % 2 == (0 if double_last else 1), d * 2).otherwise(d)
        return acc + twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _card(found: Column, key: Column) -> Column:
    """The first digit stays, the last is the check digit anew. Numbers that fail the check stay as they are."""

    def go(d: Column) -> Column:
        inner = F.substr(d, F.lit(2), F.length(d) - 2)
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permuted_text(inner, inner, key, "card"))
        new = let(body, lambda b: F.concat(b, F.pmod(10 - luhn_sum(b, True) % 10, F.lit(10)).cast("string")))
        return F.when(luhn_sum(d, False) % 10 == 0, let(new, lambda n: _dressed(found, n)))

    return let(_digits(found), go)


def _phone(found: Column, key: Column) -> Column:
    """The country code stays; leading digits of a North American number stay in 2-9."""
    american = F.regexp_like(found, F.lit(r"^(?:\+1[ .-]?|1[ .-])?\(?[2-9]\d\d\)?[ .-]?[2-9]\d\d[ .-]\d{4}$"))
    code = F.when(american, F.regexp_extract(found, r"^(\+?1[ .-]?)?(?=\(?[2-9])", 0)).otherwise(F.regexp_extract(found, r"^\+\d{1,3}", 0))
    rest = F.substr(found, F.length(code) + 1, F.length(found))
    d = _digits(rest)
    mask = F.when(american, F.lit("nddndddddd")).otherwise(F.repeat(F.lit("d"), F.length(d)))
    enough = F.length(_digits(found)).between(7, 15)
    return F.when(enough, F.concat(code, let(permuted_text(d, mask, key, "phone"), lambda n: _dressed(rest, n))))


def _ssn(found: Column, key: Column) -> Column:
    """An area of 001-665, 667-899, a group of 01-99 and a serial of 0001-9999, as one number."""
    d = _digits(found)
    area, group, serial = (F.substr(d, F.lit(i), F.lit(n)).cast("long") for i, n in ((1, 3), (4, 2), (6, 4)))
    # 898 areas x 99 groups and 9999 serials
    value = ((F.when(area > 666, area - 2).otherwise(area - 1)) * 99 + (group - 1)) * 9999 + (serial - 1)

    def go(v: Column) -> Column:
        a = F.floor(v / (99 * 9999)).cast("long")
        area = F.lpad((a + 1 + F.when(a >= 665, 1).otherwise(0)).cast("string"), 3, "0")
        group = F.lpad((F.pmod(F.floor(v / 9999), F.lit(99)) + 1).cast("string"), 2, "0")
        return F.concat_ws("-", area, group, F.lpad((F.pmod(v, F.lit(9999)) + 1).cast("string"), 4, "0"))

    return let(permuted_number(value, 898 * 99, 9999, key, "ssn"), go)


def _ip(found: Column, key: Column) -> Column:
    value = F.aggregate(F.split(found, r"\."), F.lit(0).cast("long"), lambda acc, o: acc * 256 + o.cast("long"))
    octet = lambda v, k: F.pmod(F.floor(v / (256**k)), F.lit(256)).cast("string")
    return let(permuted_number(value, 65536, 65536, key, "ip"), lambda v: F.concat_ws(".", *[octet(v, k) for k in (3, 2, 1, 0)]))


#: Dates of 1800 to 2199 whose day is after the 12th: days 13 to 28 of 4,800 months, then 29ths, 30ths and 31sts.
_LATE = 88_497
_NOT_FEBRUARY, _LONG_MONTHS = [1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12], [1, 3, 5, 7, 8, 10, 12]
_LEAP = [y for y in range(1800, 2200) if y % 4 == 0 and (y % 100 or y % 400 == 0)]


def _late_number(day: Column) -> Column:
    """The place of a date among those whose day is after the 12th."""
    y, m, d = (F.year(day) - 1800).cast("long"), F.month(day), F.dayofmonth(day)
    place = lambda values, x: F.array_position(F.array(*map(F.lit, values)), x) - 1
    return (
        F.when(d <= 28, (y * 12 + m - 1) * 16 + d - 13)
        .when((d == 29) & (m == 2), 76_800 + 4_400 + place(_LEAP, F.year(day)))
        .when(d == 29, 76_800 + y * 11 + place(_NOT_FEBRUARY, m))
        .when(d == 30, 81_297 + y * 11 + place(_NOT_FEBRUARY, m))
        .otherwise(85_697 + y * 7 + place(_LONG_MONTHS, m))
    )


def _late_date(v: Column) -> Column:
    """The date at a place: _late_number's inverse."""
    of = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    by = lambda k, n: F.floor(k / n).cast("int")
    date = lambda y, m, d: F.make_date((y + 1800).cast("int"), m.cast("int"), d.cast("int"))
    j, k, n = v - 76_800, v - 81_297, v - 85_697
    return (
        F.when(v < 76_800, date(by(v, 192), F.pmod(by(v, 16), F.lit(12)) + 1, F.pmod(v, F.lit(16)) + 13))
        .when(j < 4_400, date(by(j, 11), of(_NOT_FEBRUARY, F.pmod(j, F.lit(11))), F.lit(29)))
        .when(v < 81_297, F.make_date(of(_LEAP, j - 4_400).cast("int"), F.lit(2), F.lit(29)))
        .when(v < 85_697, date(by(k, 11), of(_NOT_FEBRUARY, F.pmod(k, F.lit(11))), F.lit(30)))
        .otherwise(date(by(n, 7), of(_LONG_MONTHS, F.pmod(n, F.lit(7))), F.lit(31)))
    )


def permuted_late(value: Column, key: Column) -> Column:
    """A number below _LATE permuted under key: the network goes over 298 * 297 numbers, and what leaves the range goes on
    until it is back. Nine numbers lie beyond it, so ten turns are enough."""
    turn = lambda v: permuted_number(v, 298, 297, key, "late date")
    zero = F.struct(value.alias("v"), F.lit(False).alias("done"))
    step = lambda a, i: F.when(a["done"], a).otherwise(let(turn(a["v"]), lambda v: F.struct(v.alias("v"), (v < _LATE).alias("done"))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(298 * 297 - _LATE + 1)), zero, step, lambda a: a["v"])


def _date(found: Column, key: Column) -> Column:
    """Year-month-day with -, day-month-year with / or .; what is no such date, month-day-year with /. Each of these
    readings is permuted within itself: a month-day-year date's day is after the 12th and stays there, so no two
    strings meet. Years 1800 to 2199; other strings stay as they are."""

    def of(fmt: str, new) -> Column:
        day = F.try_to_date(found, fmt)
        inside = (day >= F.lit("1800-01-01").cast("date")) & (day < F.lit("2200-01-01").cast("date"))
        return F.when(day.isNotNull() & inside, F.date_format(new(day), fmt))

    zero = F.lit("1800-01-01").cast("date")
    days = lambda day: F.date_add(zero, permuted_number(F.datediff(day, zero).cast("long"), 189, 773, key, "date").cast("int"))
    late = lambda day: let(permuted_late(_late_number(day).cast("long"), key), _late_date)
    return (
        F.when(found.contains("-"), of("yyyy-MM-dd", days)).when(found.contains("."), of("dd.MM.yyyy", days))
        .when(F.try_to_date(found, "dd/MM/yyyy").isNotNull(), of("dd/MM/yyyy", days)).otherwise(of("MM/dd/yyyy", late))
    )


def _email(found: Column, key: Column) -> Column:
    """The domain stays."""
    local = F.substring_index(found, "@", 1)
    return F.concat(permuted_text(local, F.repeat(F.lit("-"), F.length(local)), key, "email"), F.substr(found, F.length(local) + 1, F.length(found)))


_NEW = {"email": _email, "ip": _ip, "date": _date, "phone": _phone, "ssn": _ssn, "card": _card}


def _pseudonym(found: Column, key: Column) -> Column:
    """struct(kind, new): the kind of a find, null if it doesn't validate, and what replaces it."""
    kind = F.coalesce(*[F.when(F.regexp_like(found, F.lit(f"^(?:{p})$")), F.lit(k)) for k, p in PATTERNS.items()])

    def go(k: Column) -> Column:
        new = F.coalesce(*[F.when(k == name, make(found, key)) for name, make in _NEW.items()])
        return let(new, lambda n: F.struct(F.when(n.isNotNull(), k).alias("kind"), F.coalesce(n, found).alias("new")))

    return let(kind, go)


#: Stands before and after finds while a text is taken apart; texts that hold it are taken apart the longer way.
_MARK = "\uffff"


def _pieces(text: Column) -> Column:
    """The text cut at its finds: gap, find, gap, ..., gap. One walk of the pattern over the text."""
    longer = F.flatten(F.transform(
        F.arrays_zip(F.split(text, ANY, -1).alias("gap"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("f")), lambda x: F.array(x["gap"], x["f"])
    ))
    short = F.split(F.regexp_replace(text, ANY, f"{_MARK}$0{_MARK}"), _MARK, -1)
    # a find holds a digit or an @
    some = F.regexp_like(text, F.lit("[0-9@]"))
    return F.when(~some, F.array(text)).when(text.contains(_MARK), F.filter(longer, lambda x: x.isNotNull())).otherwise(short)


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """docs -> its columns with the finds in text replaced, and finds: array<struct<kind, new>>, those that
    validated, in order.

    Null texts stay null and hold nothing; whole texts are scanned; repeated rows stay; an empty table
    gives an empty result. Other columns pass; an own column named finds is replaced. The key is read from a
    one-row table, so it stands in no plan."""
    cols = [c for c in docs.columns if c != "finds"]
    secret = docs.sparkSession.createDataFrame([(key,)], "key string").scalar()
    none = F.array().cast("array<struct<kind:string,new:string>>")
    rows = docs.select(packed(docs, cols), secret.alias("_key"), _pieces(F.coalesce(F.col("_row.text").cast("string"), F.lit(""))).alias("_parts"))
    odd = F.filter("_parts", lambda x, i: i % 2 == 1)
    found = F.when(F.size("_parts") > 1, F.transform(odd, lambda x: _pseudonym(x, F.col("_key")))).otherwise(none)
    rows = rows.select("_row", "_parts", found.alias("_finds"))
    joined = F.array_join(F.transform("_parts", lambda x, i: F.when(i % 2 == 1, F.get("_finds", F.floor(i / 2).cast("int"))["new"]).otherwise(x)), "")
    new = F.when(F.size("_finds") > 0, joined).otherwise(F.col("_row.text").cast("string"))
    return rows.select(
        *[new.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in cols], F.filter("_finds", lambda x: x["kind"].isNotNull()).alias("finds")
    )
