import datetime
import hashlib

from seamgraph.llm.pii import _LATE, _late_date, _late_number, permuted_number, permuted_text, pseudonymize
from pyspark.sql import functions as F


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


CASES = {
    "+1 (743) 555-3824": "phone", "743-555-3824": "phone", "+44 20 7946 0958": "phone", "4111 1111 1111 1111": "card", "4465758382889437": "card",
    "152.143.123.131": "ip", "2024-02-29": "date", "31/12/1999": "date", "24.12.2020": "date", "078-05-1120": "ssn", "john.doe99@mail.example.com": "email",
}
LEFT = ["4111-1111-1111-1112", "256.1.1.1", "1.2.3.4.5", "2023-02-29", "666-12-3456", "x@y", "12345", "2024-02-291"]


def test_values_keep_their_format_and_link(spark, table):
    texts = [f"see {v}, {v}; end." for v in CASES] + [f"see {v} end" for v in LEFT] + [None, "", "é" * 40_000 + " 743-555-3824"]
    got = {r["doc_id"]: r for r in pseudonymize(table(texts), "key").collect()}
    for k, (v, kind) in enumerate(CASES.items()):
        one, two = got[k]["text"].removeprefix("see ").removesuffix("; end.").split(", ")
        assert one == two != v and [f["kind"] for f in got[k]["finds"]] == [kind] * 2
        if kind != "ip":
            assert len(one) == len(v) and all((a.isdigit(), a.isalpha()) == (b.isdigit(), b.isalpha()) for a, b in zip(one, v))
        if kind == "card":
            assert luhn(one) and one[0] == v[0]
    for k, v in enumerate(LEFT, len(CASES)):
        assert got[k]["text"] == texts[k] and got[k]["finds"] == []
    n = len(texts)
    assert got[n - 3]["text"] is None and got[n - 2]["text"] == "" and got[n - 1]["finds"][0]["kind"] == "phone"
    other = {r["doc_id"]: r["text"] for r in pseudonymize(table(texts), "another").collect()}
    assert other[0] != got[0]["text"] and pseudonymize(table(["a"]).limit(0), "k").count() == 0
    assert pseudonymize(table(texts), "key").columns == [*table(texts).columns, "finds"]


def test_numbers_side_by_side(spark, table):
    text = "4465758382889437 4111111111111111 2123465659789241, 3782 822463 10005"
    row = pseudonymize(table([text]), "k").first()
    assert [f["kind"] for f in row["finds"]] == ["card"] * 3  # the third number fails its check
    new = row["text"].replace(",", "").split(" ", 3)
    assert new[2] == "2123465659789241" and all(luhn(x) for x in (new[0], new[1], new[3])) and "4465758382889437" not in row["text"]


def test_permutations_are_one_to_one(spark):
    k = F.lit("k")
    n = spark.range(189 * 773).select(permuted_number(F.col("id"), 189, 773, k, "date").alias("x"))
    assert n.distinct().count() == 189 * 773 and n.agg(F.min("x"), F.max("x")).first()[:] == (0, 189 * 773 - 1)
    t = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("v")).select(permuted_text(F.col("v"), F.lit("dddd"), k, "t").alias("x"))
    assert t.distinct().count() == 10_000
    lead = spark.range(200, 1000).select(F.col("id").cast("string").alias("v")).select(permuted_text(F.col("v"), F.lit("ndd"), k, "t").alias("x"))
    assert lead.distinct().count() == 800 and lead.filter("x < '200'").count() == 0


def feistel(value, a, b, key, kind):
    """The network over a * b numbers, in plain Python."""
    l, r = divmod(value, b)
    for i in range(8):
        h = hashlib.sha512("\x1f".join([key, kind, str(i), str(r)]).encode()).hexdigest()
        l, r = r, (l + int(h[:12], 16)) % (a if i % 2 == 0 else b)
    return l * b + r


def letters(value, mask, key, kind):
    cut = len(value) // 2
    l, r, m, k = value[:cut], value[cut:], mask[:cut], mask[cut:]
    for i in range(8):
        h = hashlib.sha512("\x1f".join([key, kind, str(i), str(len(l)), r]).encode()).hexdigest()
        new = ""
        for j, c in enumerate(l):
            by = int(h[j % 32 * 4 : j % 32 * 4 + 4], 16)
            low, n = (50, 8) if m[j] == "n" else (48, 10) if c.isdigit() else (97, 26) if c.islower() else (65, 26) if c.isupper() else (0, 0)
            new += chr((ord(c) - low + by) % n + low) if n else c
        l, r, m, k = r, new, k, m
    return l + r


def test_against_plain_python(spark, table):
    zero = datetime.date(1800, 1, 1)
    late = [d for k in range(400 * 366) if (d := zero + datetime.timedelta(k)).year < 2200 and d.day > 12]
    order = {d: k for k, d in enumerate(sorted((d for d in late if d.day <= 28), key=lambda d: (d.year, d.month, d.day)))}
    for day in (29, 30, 31):
        own = [d for d in late if d.day == day]
        for d in sorted(own, key=lambda d: (d.month == 2, d.year, d.month)):
            order[d] = len(order)
    assert len(order) == _LATE

    def date(text):
        if "-" in text:
            fmt = "%Y-%m-%d"
        elif "." in text:
            fmt = "%d.%m.%Y"
        else:
            try:
                datetime.datetime.strptime(text, fmt := "%d/%m/%Y")
            except ValueError:
                v = order[datetime.datetime.strptime(text, "%m/%d/%Y").date()]
                v = feistel(v, 298, 297, "k", "late date")
                while v >= _LATE:
                    v = feistel(v, 298, 297, "k", "late date")
                return {k: d for d, k in order.items()}[v].strftime("%m/%d/%Y")
        days = (datetime.datetime.strptime(text, fmt).date() - zero).days
        return (zero + datetime.timedelta(feistel(days, 189, 773, "k", "date"))).strftime(fmt)

    def ssn(text):
        a, g, n = map(int, text.split("-"))
        v = feistel(((a - (2 if a > 666 else 1)) * 99 + g - 1) * 9999 + n - 1, 898 * 99, 9999, "k", "ssn")
        a = v // (99 * 9999)
        return f"{a + 1 + (a >= 665):03}-{v // 9999 % 99 + 1:02}-{v % 9999 + 1:04}"

    def card(text):
        d = "".join(c for c in text if c.isdigit())
        body = d[0] + letters(d[1:-1], d[1:-1], "k", "card")
        new = iter(next(body + str(c) for c in range(10) if luhn(body + str(c))))
        return "".join(next(new) if c.isdigit() else c for c in text)

    def ip(text):
        v = 0
        for o in text.split("."):
            v = v * 256 + int(o)
        v = feistel(v, 65536, 65536, "k", "ip")
        return ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))

    def email(text):
        local, rest = text.split("@")
        return letters(local, "-" * len(local), "k", "email") + "@" + rest

    cases = [(v, date(v)) for v in ("2024-02-29", "1800-01-01", "2199-12-31", "31/12/1999", "01/02/2003", "02/13/1999", "02/29/2000", "12/31/2024", "06/30/1850", "24.12.2020")]
    cases += [(v, ssn(v)) for v in ("078-05-1120", "665-01-0001", "899-99-9999")] + [(v, card(v)) for v in ("4111 1111 1111 1111", "4465758382889437", "3782 822463 10005")]
    cases += [(v, ip(v)) for v in ("152.143.123.131", "0.0.0.0")] + [(v, email(v)) for v in ("john.doe99@mail.example.com", "A_b-9@x.org", "q@x.org")]
    cases += [("(743) 555-3824", "(" + (n := letters("7435553824", "nddndddddd", "k", "phone"))[:3] + ") " + n[3:6] + "-" + n[6:])]
    got = {r["doc_id"]: r["text"] for r in pseudonymize(table([f"see {v} end" for v, _ in cases]), "k").collect()}
    assert [got[k] for k in range(len(cases))] == [f"see {w} end" for _, w in cases]


def test_dates_stay_apart(spark):
    """Every string of either reading of / has a pseudonym of its own."""
    days = spark.range(3 * 366).select(F.date_add(F.lit("1999-06-01").cast("date"), F.col("id").cast("int")).alias("d"))
    both = days.select(F.date_format("d", "dd/MM/yyyy").alias("text")).union(days.select(F.date_format("d", "MM/dd/yyyy").alias("text"))).distinct()
    docs = both.withColumn("doc_id", F.monotonically_increasing_id())
    out = pseudonymize(docs, "k")
    assert out.select("text").distinct().count() == both.count() == out.filter(F.size("finds") == 1).count()
    n = spark.range(_LATE).select(F.col("id").alias("n"), _late_date(F.col("id")).alias("d"))
    assert n.filter(F.dayofmonth("d") > 12).select("d").distinct().count() == _LATE and n.filter(_late_number(F.col("d")) != F.col("n")).count() == 0


def test_repeats_clashes_marks_and_the_key(spark):
    rows = [(1, "a\uffff 743-555-3824 \uffffb x@y.org", [1]), (1, "a\uffff 743-555-3824 \uffffb x@y.org", [1]), (2, "743-555-3824", None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, finds array<int>")
    out = pseudonymize(docs, "a-key-to-hide")
    got = out.collect()
    assert got[0] == got[1] and [f["kind"] for f in got[0]["finds"]] == ["phone", "email"] and got[0]["text"].count("\uffff") == 2
    assert got[2]["text"] == got[0]["finds"][0]["new"] == got[0]["text"].split()[1] and got[3]["text"] is None
    assert "a-key-to-hide" not in out._jdf.queryExecution().toString()


def test_many_finds_in_one_text(spark, table):
    text = " ".join(f"+1 743-555-{k:04}" for k in range(3000))
    row = pseudonymize(table([text]), "k").first()
    assert len(row["finds"]) == 3000 and len({f["new"] for f in row["finds"]}) == 3000
