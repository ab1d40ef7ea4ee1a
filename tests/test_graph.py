"""Traversal on random graphs against a few lines of Python."""

import random
from collections import deque

from seamgraph.operators import graph


def walk(edges, seeds, depth, reverse):
    out, queue = {}, deque((s, 0) for s in sorted(set(seeds)))
    while queue:
        node, d = queue.popleft()
        if node in out:
            continue
        out[node] = d
        for a, b in edges:
            a, b = (b, a) if reverse else (a, b)
            if a == node and b is not None and a is not None and (depth is None or d < depth):
                queue.append((b, d + 1))
    return out


def test_reach(spark):
    rng = random.Random(5)
    pairs = [(f"v{rng.randrange(40)}", f"v{rng.randrange(40)}" if rng.random() < 0.9 else None) for _ in range(60)]
    edges = spark.createDataFrame(pairs, "source string, target string")
    for depth, reverse in ((0, False), (2, False), (3, True), (None, True)):
        got = {r["node"]: r["depth"] for r in graph.reach(edges, graph.seeds_of(spark, ["v1", "v2", "gone"]), depth, reverse).collect()}
        assert got == walk(pairs, ["v1", "v2", "gone"], depth, reverse)


def test_forward_and_reverse_are_dual(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "c")], "source string, target string")
    forward = {r["node"] for r in graph.reach(edges, graph.seeds_of(spark, ["x"]), None).collect()}
    back = {r["node"] for r in graph.reach(edges, graph.seeds_of(spark, ["b"]), None, reverse=True).collect()}
    assert "b" in forward and "x" in back
