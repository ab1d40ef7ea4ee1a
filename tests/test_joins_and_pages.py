"""Containment, pages and bounds on small tables against a few lines of Python."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from seamgraph.operators import graph, joins, paging
from seamgraph.sources.inventory import language_column


def test_containment_keeps_points_with_nulls_and_repeats(spark):
    rng = random.Random(1)
    points = [(rng.choice([None, "a"]), rng.randrange(0, 400), None) for _ in range(80)] + [(None, None, None), ("a", 5, None), ("a", 5, None)]
    spans = [(f"s{k}", lo, lo + rng.choice([0, 1, 7, 90, 200])) for k, lo in enumerate(rng.randrange(0, 380) for _ in range(40))]
    p = spark.createDataFrame(points, "_row string, at long, other string")
    s = spark.createDataFrame(spans, "name string, lo long, hi long")

    def best(at):
        held = [(hi - lo, n) for n, lo, hi in spans if at is not None and lo <= at < hi]
        return min(held)[1] if held else None

    got = joins.contained_in(p, "at", s, "lo", "hi", "name", 50)
    assert got.columns == ["_row", "at", "other", "name"]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, ((*x, best(x[1])) for x in points)))


@pytest.mark.parametrize("kind", ["int", "long", "double", "decimal(9,2)"])
def test_containment_of_long_short_and_fractional_spans(spark, kind):
    rng = random.Random(2)
    part = {"double": 8, "decimal(9,2)": 100}.get(kind, 1)
    as_kind = {"double": float, "decimal(9,2)": Decimal}.get(kind, int)
    number = lambda k: as_kind(k) / part if part > 1 else k
    starts = [rng.randrange(-900 * part, 900 * part) for _ in range(150)]
    spans = [(k % 120, number(lo), number(lo + rng.choice([-3, 0, 1, 2, 5, 16, 17, 130, 1024, 1500]) * rng.choice([1, part]))) for k, lo in enumerate(starts)]
    spans += [(None, number(3), number(9)), (7, None, number(9)), (8, number(1), None)]
    points = [(k, number(k)) for k in (rng.randrange(-1000 * part, 1000 * part) for _ in range(300))] + [(1, None)]
    points += [(0, at) for _, lo, hi in spans for at in (lo, hi)]
    p = spark.createDataFrame(points, f"id int, at {kind}")
    s = spark.createDataFrame(spans, f"name int, lo {kind}, hi {kind}")

    def best(at):
        held = [(hi - lo, n is None, n) for n, lo, hi in spans if None not in (at, lo, hi) and lo <= at < hi]
        return min(held)[2] if held else None

    plain = lambda rows: sorted(repr((k, None if at is None else float(at), n)) for k, at, n in rows)
    for step in (1, 7, 64, 5000):
        got = joins.contained_in(p, "at", s, "lo", "hi", "name", step)
        assert plain(got.collect()) == plain((*x, best(x[1])) for x in points)


def test_containment_makes_no_row_for_each_pair_that_meets(spark):
    n = 3000
    p = spark.range(n).select("id", (F.col("id") % 1000).alias("at"))
    s = spark.range(n).select(F.col("id").alias("name"), (F.col("id") * -7 % 400).alias("lo"), (F.col("id") % 600 + 500).alias("hi"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan's counts can be read
    try:
        got = joins.contained_in(p, "at", s, "lo", "hi", "name", 3600)
        assert len(got.collect()) == n
        left, most = [got._jdf.queryExecution().executedPlan()], 0
        while left:
            node = left.pop()
            children = node.children()
            left += [children.apply(k) for k in range(children.size())]
            if node.metrics().contains("numOutputRows"):
                most = max(most, node.metrics().apply("numOutputRows").value())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert n <= most <= 20 * n


def test_text_pages_never_cut_a_character(spark):
    texts = ["", "a" * 25, "é" * 13, "漢字" * 7, "a😀b" * 9, "plain é 漢 😀 end", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for size in (4, 5, 7, 64):
        rows = sorted(paging.text_pages(df, "text", size).collect(), key=lambda r: (r["id"], r["offset_bytes"]))
        for k, t in enumerate(texts):
            own = [r for r in rows if r["id"] == k]
            assert "".join(r["page"] for r in own) == (t or "") and len(own) >= (t is not None)
            assert all(len(r["page"].encode()) <= size for r in own) and [r["slice_complete"] for r in own] == [False] * (len(own) - 1) + [True] * bool(own)
            at = 0
            for r in own:
                assert r["offset_bytes"] == at
                at += len(r["page"].encode())
    with pytest.raises(ValueError):
        paging.text_pages(df, "text", 3)


def test_budget_pages(spark):
    df = spark.createDataFrame([(k % 2, k, 10) for k in range(40)], "g int, k int, c int")
    got = paging.budget_page(df, "g", "k", "c", 3, 4, 30).collect()
    assert sorted((r["g"], r["k"], r["position"], r["spent"]) for r in got) == [(g, 2 * (3 + i) + g, 3 + i, 10 * (i + 1)) for g in (0, 1) for i in range(3)]
    plan = paging.budget_page(df, "g", "k", "c", 3, 4, 30)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_bounded_walks(spark):
    rng = random.Random(2)
    pairs = [(f"e{k}", f"v{rng.randrange(30)}", f"v{rng.randrange(40)}" if rng.random() < 0.9 else None) for k in range(90)]
    edges = spark.createDataFrame(pairs, "id string, source string, target string")
    for depth, nodes, many in ((3, 5, 100), (2, 100, 6), (9, 100, 1000), (0, 3, 3)):
        level, seen = ["v1", "v2"], {}
        for d in range(depth + 1):
            seen |= {v: d for v in level}
            level = sorted({t for _, s, t in pairs if s in level and t} - set(seen))
        order = sorted(seen, key=lambda v: (seen[v], v))
        kept = order[:nodes]
        out = sorted((e for e in pairs if e[1] in kept), key=lambda e: (seen[e[1]], e[1], e[0]))
        partial = len(order) > nodes or len(out) > many or any(t and t not in kept for _, _, t in out[:many])
        n, e, status = graph.bounded(edges, graph.seeds_of(spark, ["v2", "v1"]), depth, nodes, many)
        assert {r["node"]: r["depth"] for r in n.collect()} == {v: seen[v] for v in kept}
        assert sorted(tuple(r) for r in e.collect()) == sorted(out[:many]) and status.first()[0] == ("Partial" if partial else "Complete")


def test_large_frontiers(spark, monkeypatch):
    edges = spark.createDataFrame([(f"a{k % 7}", f"b{k}") for k in range(50)] + [(f"b{k}", f"a{k % 3}") for k in range(50)], "source string, target string")
    want = {(r["node"], r["depth"]) for r in graph.reach(edges, graph.seeds_of(spark, ["a1", "a2"]), None).collect()}
    for in_filter, in_broadcast in ((0, 10**6), (0, 0)):
        monkeypatch.setattr(graph, "IN_FILTER", in_filter)
        monkeypatch.setattr(graph, "IN_BROADCAST", in_broadcast)
        assert {(r["node"], r["depth"]) for r in graph.reach(edges, graph.seeds_of(spark, ["a1", "a2"]), None).collect()} == want


def test_languages(spark):
    given = {"a/x.py": "python", "Makefile": "make", "b/Cargo.lock": "toml", "x.tar": None, ".sh": None, "run": "bash", "tool": "python", "n.md": "documentation", "y.bzl": "starlark"}
    lines = {"run": "#!/usr/bin/env bash", "tool": "#!/usr/bin/python3", "x.tar": "#!/bin/sh"}
    df = spark.createDataFrame([(p, lines.get(p)) for p in given], "path string, line string")
    got = {r["path"]: r["l"] for r in df.select("path", language_column(F.col("path"), F.col("line")).alias("l")).collect()}
    assert got == given
