import random

from seamgraph.llm.linededup import line_dedup


def brute(rows, run=3):
    """rows in the order of doc_id, one each."""
    lines = [(t or "").split("\n") for t in rows]
    units = [[k for k, x in enumerate(own) if x.strip(" \t\n\v\f\r")] for own in lines]
    seen, gone = set(), [set() for _ in rows]
    for d, own in enumerate(units):
        for k in range(len(own) - run + 1):
            key = tuple(lines[d][i] for i in own[k : k + run])
            if key in seen:
                gone[d] |= set(own[k : k + run])
            seen.add(key)
    return [None if t is None else "\n".join(x for k, x in enumerate(own) if k not in g) for t, own, g in zip(rows, lines, gone)], [len(g) for g in gone]


def test_against_brute_force(spark, table):
    rng = random.Random(2)
    pool = [f"line {k}" for k in range(12)] + ["", "  ", "common"] * 3
    texts = [None, "", "\n\n\n", "one", "a\nb\nc\na\nb\nc\na\nb\nc", "x\n" * 500]
    texts += ["\n".join(rng.choices(pool, k=rng.randint(0, 25))) for _ in range(150)]
    got = {r["doc_id"]: r for r in line_dedup(table(texts)).collect()}
    kept, removed = brute(texts)
    for k, t in enumerate(texts):
        assert (got[k]["text"], got[k]["n_removed"], got[k]["n_lines"]) == (kept[k], removed[k], 0 if t is None else t.count("\n") + 1), t
    assert sum(removed) > 50


def test_columns_repeats_and_nothing(spark, table):
    docs = table(["a\nb\nc", "a\nb\nc", "a\nb\nc"], ids=[5, 5, None])
    got = sorted((r["doc_id"] is None, r["text"]) for r in line_dedup(docs).collect())
    # a null doc_id counts as 0: its text is the first place; the two equal rows are one later place
    assert got == [(False, ""), (False, ""), (True, "a\nb\nc")]
    assert line_dedup(docs).columns == [*docs.columns, "n_lines", "n_removed"]
    assert line_dedup(docs.limit(0)).count() == 0


def test_long_runs_of_few_lines(spark, table, words):
    long, half = " ".join(words * 3), " ".join(words[:19] + words[:7])
    texts = [long, long, f"{half}\n\n{half} x", f"own\n{half}\n{half} x\nother", half, half, f"{long}\nshort"]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup(table(texts), min_words=50).collect()}
    assert got == {0: (long, 0), 1: ("", 1), 2: (texts[2], 0), 3: ("own\nother", 2), 4: (half, 0), 5: (half, 0), 6: ("short", 1)}


def test_query_matches_sql(spark):
    import duckdb
    import pytest

    from seamgraph.llm.queries import oracle_sql, queries

    path = "/root/testdata/sf0.01"
    con = duckdb.connect()
    try:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet')")
    except duckdb.IOException:
        pytest.skip("needs the driver's tables")
    got = queries()["op6_line_dedup"](spark, path)
    want = con.execute(oracle_sql()["op6_line_dedup"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and got.columns == [c[0] for c in con.description]
    assert sum(r[2] for r in want) > 0


def test_the_pipeline_drops_copies_of_one_line(spark, table, words):
    import pytest

    pipeline = pytest.importorskip("corpus_pipeline")
    long = " ".join(words * 3)
    got = {r["doc_id"]: r["text"] for r in dict(pipeline.STAGES)["line dedup"](spark, table([long, long]), "").collect()}
    assert got == {0: long, 1: ""}


def test_repeated_rows_and_maps(spark):
    rows = [(None, "a\nb\nc", {"k": 1}, "x"), (None, "a\nb\nc", {"k": 1}, "x"), (None, "a\nb\nc", {"k": 1}, "x"), (3, "p\nq", None, None), (3, "p\nq", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>, runs string")
    got = line_dedup(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    # one of the equal rows stays; two lines are no run
    assert sorted((r["doc_id"] or 0, r["text"], r["n_removed"]) for r in got.collect()) == [(0, "", 3), (0, "", 3), (0, "a\nb\nc", 0), (3, "p\nq", 0), (3, "p\nq", 0)]


def test_only_chosen_units_are_kept_and_extension_finds_the_runs(spark, table):
    from pyspark.sql import functions as F
    from seamgraph.llm.linededup import _keyed, fingerprints

    text = "\n".join(f"line {k} of many" for k in range(300))
    marks = fingerprints(_keyed(table([text])), 3, None)
    n = marks.count()
    assert n < 200 and marks.agg(F.sum(F.size("ways"))).first()[0] == 298  # every window chose one unit
