"""Bounded traversal and closure over an edge table (source, target, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import cut


def seeds_of(spark: SparkSession, nodes: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in sorted(set(nodes))], "node string")


def neighbours(edges: DataFrame, node: str, reverse: bool = False) -> DataFrame:
    """The edges that leave a node, or reach it."""
    return edges.filter(F.col("target" if reverse else "source") == node)


#: A frontier of so many nodes goes into the scan as a filter; up to the next bound it travels to the edges; larger ones are shuffled.
IN_FILTER, IN_BROADCAST = 256, 1_000_000


def _steps_from(steps: DataFrame, front: DataFrame, n: int) -> DataFrame:
    """The steps that leave the n nodes of a frontier, by a way that its checked size allows."""
    if n <= IN_FILTER:
        return steps.filter(F.col("_from").isin([r[0] for r in front.collect()]))
    own = front.select(F.col("node").alias("_from"))
    return steps.join(F.broadcast(own) if n <= IN_BROADCAST else own.hint("shuffle_hash"), "_from", "left_semi")


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None, reverse: bool = False, max_nodes: int | None = None) -> DataFrame:
    """(node, depth): every node within max_depth steps of a seed, by its least depth. None: no bound. With max_nodes,
    the first so many in the order of depth, then node; deeper levels are then not looked at.

    A breadth-first frontier: each step is one pass over the edges, filtered by the last step's new nodes, and only
    what it finds is made distinct; repeated edges do no harm. Null targets are never followed."""
    here, there = ("target", "source") if reverse else ("source", "target")
    steps = edges.select(F.col(here).alias("_from"), F.col(there).alias("_to")).filter("_from IS NOT NULL AND _to IS NOT NULL")
    first = seeds.select("node").distinct()
    front = cut((first.orderBy("node").limit(max_nodes) if max_nodes is not None else first).withColumn("depth", F.lit(0)))
    n, total, depth = front.count(), 0, 0
    levels = [(front, n)]
    while n and (max_depth is None or depth < max_depth):
        depth, total = depth + 1, total + n
        if max_nodes is not None and total >= max_nodes:
            break
        found = _steps_from(steps, front.select("node"), n).select(F.col("_to").alias("node")).distinct()
        for level, size in levels:  # by level, so that each one's own size decides how it is joined
            known = level.select("node")
            found = found.join(F.broadcast(known) if size <= IN_BROADCAST else known, "node", "left_anti")
        if max_nodes is not None:
            found = found.orderBy("node").limit(max_nodes - total)
        front = cut(found.withColumn("depth", F.lit(depth)))
        n = front.count()
        levels.append((front, n))
        if len(levels) > LEVELS:
            levels = [(cut(_union(levels[:-1])), total), (front, n)]
    return _union(levels)


#: Levels that stand side by side before they are written as one.
LEVELS = 8


def _union(levels: list[tuple[DataFrame, int]]) -> DataFrame:
    out = levels[0][0]
    for level, _ in levels[1:]:
        out = out.unionByName(level)
    return out


def bounded(edges: DataFrame, seeds: DataFrame, max_depth: int, max_nodes: int, max_edges: int, reverse: bool = False, key: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, status) of a breadth-first traversal within bounds. nodes: the first max_nodes in the order of
    depth, then node. edges: those that leave these nodes, the first max_edges in the order of their node's depth, the
    node and their key. status is Partial if a node or an edge within the depth was left out, or if what the last depth's
    edges point to was not reached, else Complete."""
    here, there = ("target", "source") if reverse else ("source", "target")
    wider = cut(reach(edges, seeds, max_depth, reverse, max_nodes + 1))
    nodes = wider.orderBy("depth", "node").limit(max_nodes)
    mine = edges.join(nodes.select(F.col("node").alias(here), F.col("depth").alias("_depth")), here)
    more = cut(mine.orderBy("_depth", here, key).limit(max_edges + 1))
    kept = more.orderBy("_depth", here, key).limit(max_edges)
    beyond = kept.filter(F.col(there).isNotNull()).join(nodes.select(F.col("node").alias(there)), there, "left_anti")
    # one row each: how many were left out
    left = [x.agg(F.count("*").alias("n")).scalar() for x in (wider, more, beyond)]
    partial = (left[0] > max_nodes) | (left[1] > max_edges) | (left[2] > 0)
    status = edges.sparkSession.range(1).select(F.when(partial, "Partial").otherwise("Complete").alias("status"))
    return nodes, kept.select(*edges.columns), status


def edges_within(edges: DataFrame, reached: DataFrame, reverse: bool = False) -> DataFrame:
    """The edges of all reached nodes, those at the last depth included."""
    key = "target" if reverse else "source"
    return edges.join(reached.select(F.col("node").alias(key)), key, "left_semi")


def open_ends(edges: DataFrame, reached: DataFrame, reverse: bool = False) -> DataFrame:
    """Nodes just beyond what was reached: a traversal with none is complete."""
    there = "source" if reverse else "target"
    ends = edges_within(edges, reached, reverse).select(F.col(there).alias("node")).filter("node IS NOT NULL").distinct()
    return ends.join(reached.select("node"), "node", "left_anti")
