"""SimHash near-dedup: fingerprints, segment-popcount grid join, components.

Distinct fingerprints are points in a grid: the 64 bits are cut into 32 segments of two bits, and
a point's coordinates are its segments' bit counts. The Manhattan distance of two points is at
most the Hamming distance of their fingerprints. With at most three differing bits, one of the
two halves (16 coordinates each) differs by at most one, so a range join of radius one on the
half's cell finds every link: each point is sent to its own cell and, from the other side, to
the cells one step up, which covers steps down by symmetry. Candidates then pass the Manhattan
bound over all coordinates and are verified exactly.

Inside a cell only a spanning forest of the links is kept. A cell with more than `cell_cap`
entries is dealt as a grid of blocks (each row block against each column block), so that no task
holds it whole and no pair is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, forget, packed, row_hash
from .components import connected_components

#: Hamming distance at which fingerprints link.
DISTANCE = 3
#: Entries of one grid cell that one task compares at a time.
CELL_CAP = 1024
#: The mask that picks each segment's lower bit.
LOW = 0x5555555555555555


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a whole text over 3-word shingles, repeats included."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(w) - 2)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):  # bounds memory on very long texts
        part = w[i : i + (1 << 16) + 2] if len(w) >= 3 else w
        shingles = map(join, zip(part, part[1:], part[2:])) if len(part) >= 3 else [join(part)]
        h = np.array([digest(s, 42) for s in shingles], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp): one row per document; h is the text's hash. A null text counts as empty: fingerprint
    zero."""

    def go(batches):
        import pyarrow as pa

        for b in batches:
            fp = [fingerprint(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], ["doc_id", "h", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(go, "doc_id long, h long, fp long")


def _cells(points: DataFrame) -> DataFrame:
    """(cell, fp, up): grid entries. up is null for a point in its own cell, else true for one
    that reached the cell from one step below."""

    def go(batches):
        import pyarrow as pa

        weight = (3 ** np.arange(16)).astype(np.int64)
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo in range(0, len(fp), 20_000):
                f = fp[lo : lo + 20_000]
                u = f.view(np.uint64)
                seg = ((u[:, None] >> np.arange(0, 64, 2, dtype=np.uint64)) & np.uint64(3)).astype(np.int64)
                seg = (seg & 1) + (seg >> 1)
                for half in (0, 1):
                    c = seg[:, 16 * half : 16 * half + 16]
                    base = (c * weight).sum(1) * 2 + half
                    i, j = np.nonzero(c < 2)
                    cell = np.concatenate([base, base[i] + 2 * weight[j]])
                    who = np.concatenate([f, f[i]])
                    up = np.concatenate([np.zeros(len(f), bool), np.ones(len(i), bool)])
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(who), pa.array(up)], ["cell", "fp", "up"])

    return points.select("fp").mapInArrow(go, "cell long, fp long, up boolean")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _coordinates(x: np.ndarray) -> np.ndarray:
    """Bit counts of 32 two-bit segments, packed two bits each."""
    low = np.uint64(LOW)
    return (x & low) + ((x >> np.uint64(1)) & low)


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """L1 distance of packed coordinates: sum over segments of the absolute difference of values 0..2."""
    low, high = np.uint64(LOW), np.uint64(LOW << 1)
    x = a ^ b  # per segment 0^0=0, 0^1=1, 1^2=3, 0^2=2: one step for 1 and 3, two for 2
    two = (x & high) & ~((x & low) << np.uint64(1))
    return np.bitwise_count(x & low) + 2 * np.bitwise_count(two)


def _forest(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links i-j over positions of fp: every node to the least of its part."""
    node = np.unique(np.concatenate([i, j]))
    a, b = np.searchsorted(node, i), np.searchsorted(node, j)
    root = np.arange(len(node))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(node))
    return fp[node[keep]], fp[node[root[keep]]]


def _links(cells: DataFrame, distance: int, cell_cap: int) -> DataFrame:
    """(u, v): a spanning forest of the links in every cell."""
    count = cells.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > cell_cap)
    hot = durable(count.select("cell", F.ceil(F.col("n") / cell_cap).cast("int").alias("k")), "hot-cells")
    k, mine = F.coalesce("k", F.lit(1)), F.pmod(F.xxhash64("fp"), F.coalesce("k", F.lit(1))).cast("int")
    others = F.sequence(F.lit(0), F.col("k") - 1)
    # role bits: 1 own-cell row, 2 row from below, 4 column; 3 stands for an own-cell point that is row and column
    whole = F.array(F.struct(F.lit(0).alias("block"), F.when(F.col("up"), 2).otherwise(3).alias("role")))
    as_row = F.transform(others, lambda o: F.struct((F.col("mine") * F.col("k") + o).alias("block"), F.when(F.col("up"), 2).otherwise(1).alias("role")))
    as_col = F.transform(others, lambda o: F.struct((o * F.col("k") + F.col("mine")).alias("block"), F.lit(4).alias("role")))
    blocks = F.when(F.col("k") == 1, whole).when(F.col("up"), as_row).otherwise(F.concat(as_row, as_col))
    rows = cells.join(hot, "cell", "left").select("cell", "fp", "up", k.alias("k"), mine.alias("mine")).select("cell", "fp", F.inline(blocks))

    def go(batches):
        import pyarrow as pa

        def work(cell, block, fp, role):
            n = len(fp)
            col = (role == 3) | (role == 4)
            xy = _coordinates(fp.view(np.uint64))
            at_i, at_j = [], []
            lag = 1
            live = np.arange(n - 1)
            while len(live):
                live = live[live + lag < n]
                live = live[(cell[live] == cell[live + lag]) & (block[live] == block[live + lag])]
                if not len(live):
                    break
                other = live + lag
                use = (col[live] | col[other]) & (_manhattan(xy[live], xy[other]) <= distance)
                p, q = live[use], other[use]
                near = _popcount((fp[p] ^ fp[q]).view(np.uint64)) <= distance
                p, q = p[near], q[near]
                diff = fp[p] != fp[q]
                at_i.append(p[diff])
                at_j.append(q[diff])
                lag += 1
            i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at_i, at_j))
            if not len(i):
                return None
            # within one batch the same fingerprint in different cells is one node
            uniq, inv = np.unique(fp, return_inverse=True)
            u, v = _forest(uniq, inv[i], inv[j])
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        rest = None
        for b in batches:
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if rest is not None:
                cols = [np.concatenate([r, c]) for r, c in zip(rest, cols)]
            cell, block = cols[0], cols[1]
            if not len(cell):
                continue
            last = int(np.flatnonzero((cell != cell[-1]) | (block != block[-1]))[-1]) + 1 if ((cell != cell[-1]) | (block != block[-1])).any() else 0
            rest = [c[last:] for c in cols]
            if last and (out := work(*(c[:last] for c in cols))) is not None:
                yield out
        if rest is not None and (out := work(*rest)) is not None:
            yield out

    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.select("cell", F.col("block").cast("int"), "fp", F.col("role").cast("int"))
        .repartition(n, "cell", "block").sortWithinPartitions("cell", "block").mapInArrow(go, "u long, v long")
    )


def near_groups(fps: DataFrame, distance: int = DISTANCE, cell_cap: int = CELL_CAP) -> DataFrame:
    """fps(doc_id, fp, ...) -> its columns, root (one per component) and
    component_id: the least doc_id reachable over links between
    fingerprints at `distance` or fewer bits. Null doc_ids never name a component unless all are null."""
    if distance > 3:
        raise ValueError("the grid's radius holds for distances up to 3")
    points = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    links = _links(_cells(points), distance, cell_cap)
    parts = connected_components(links, "fp-links")
    named = points.join(parts, points.fp == parts.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    low = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(low, "root").select("fp", "root", "component_id")
    return fps.join(of, "fp").select(*fps.columns, "root", "component_id")


def simhash_near_dups(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, h, fp, root, component_id), one row per document.

    Null or empty texts have fingerprint zero and link like any other; repeated rows stay repeated;
    an empty table gives an empty result; extra columns are ignored."""
    return near_groups(durable(fingerprints(docs), "fingerprints"))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Filter: of each near-duplicate group the row of the least doc_id stays, whole; if several rows have
    that doc_id, the one with the least hash of its text, then of all its columns. A null doc_id comes last."""
    groups = simhash_near_dups(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "h")).alias("m")
    wins = groups.groupBy("root").agg(first).select(F.coalesce("m.doc_id", F.lit(0)).alias("_id"), F.col("m.h").alias("_h")).distinct()
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_h")]
    rows = docs.select(packed(docs), *key, row_hash(docs).alias("_all")).join(wins, ["_id", "_h"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("_id", "_h").orderBy("_all"))
    return rows.withColumn("_nth", nth).filter("_nth = 1").select(*[F.col("_row")[c].alias(c) for c in docs.columns])
