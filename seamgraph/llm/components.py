"""Connected components by alternating star contraction, as DataFrame joins and aggregates.

Every step is a min per node (with map-side partial sums) and an equi-join whose large side
the engine may split; no node's neighbours are ever gathered in one place. The edge list never
grows, and each round is written to the shared folder so that a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, forget


def _sig(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """edges(u, v): u != v, any order, repeats allowed. Returns (node, root), root the least node
    reachable, for nodes with an edge. No edges: an empty table."""
    cur = durable(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), name
    )
    sig = _sig(cur)
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # every larger neighbour hangs on the least of the neighbourhood
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        mid = durable(large, name)
        low = mid.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            mid.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        new = durable(small, name)
        now = _sig(new)
        forget(cur, mid)
        cur = new
        if now == sig:
            break
        sig = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
