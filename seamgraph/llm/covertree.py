"""Embedding near-dedup by dual traversal of cover trees.

Unit vectors with cosine c are sqrt(2 - 2 c) apart, so links are the pairs within a distance. The tree's upper levels are
nested balls of halving radii (1, 1/2, 1/4, ...) about centres, a net of a bounded sample of the vectors: a vector belongs
to the least such ball of its nearest centre. Vectors beyond radius 1 of every centre are one node without bounds. A
node's vectors are dealt into blocks of bounded size, and each block carries the lower levels, whose radii halve again.
Pairs of upper nodes, then of nodes level by level, are dropped when their centres are farther apart than the distance
plus both covering radii (and, about one centre, when their rings are), which are measured, not nominal; they are accepted
whole, without listing their members, when even the farthest members must be within it. What is left is compared in
double precision. Each block pair is one bounded task, so a cluster with a third of all vectors is many tasks.

The sample only decides how well the tree prunes: every vector is in it, and no pair is lost. Vectors without any
structure (spread evenly over many dimensions) can't be pruned by covering radii: their blocks all stay open.

Counts of links are added up from both kinds; of the links themselves a spanning forest of each task goes
on to the components.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, forget
from .components import connected_components
from .simhash import _forest

COSINE = 0.9
#: Vectors from which the upper levels' centres are taken, those with the least hashes; of 256 components, fewer if they have more.
SAMPLE = 8192
#: Centres at most: those that most vectors of the sample are near to.
CENTRES = 1024
#: A ball with less than a block's rows over this is no node of its own.
SMALL = 16
#: Balls about a centre: radii 1, 1/2, ... 2^-4.
RINGS = 5
BLOCK_ROWS = 4096
#: Radii of the levels below a block; the last level is the vectors themselves. Wider nodes than these bound nothing:
#: two of radius 1 stay open at any distance that unit vectors without likeness have.
RADII = (0.5, 0.25)
_EPS = 1e-9
#: Room for the error of distances that are taken from cosines.
_ROOM = 1e-6
#: Row pairs from which a pair of nodes is worth accepting whole.
WHOLE = 64


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]  # squares of very large or small components stay in range
    return x / np.sqrt((x * x).sum(1))[:, None]


def net(x: np.ndarray, radius: float, most: int, least: int = 2) -> np.ndarray:
    """Of the unit rows of x, no two within the radius of each other, those that have `least` rows within it: at
    most so many, those with most."""
    near = 1 - radius * radius / 2
    centres, count, n = np.empty_like(x), np.zeros(len(x), np.int64), 0
    for lo in range(0, len(x), 512):
        part = x[lo : lo + 512]
        left = np.arange(len(part))
        if n:
            cos = part @ centres[:n].T
            best = cos.argmax(1)
            held = cos[left, best] >= near
            np.add.at(count, best[held], 1)
            left = left[~held]
        inner = part[left] @ part[left].T >= near
        free = np.ones(len(left), bool)
        for k in range(len(left)):
            if free[k]:
                mine = free & inner[k]
                centres[n], count[n] = part[left[k]], mine.sum()
                free &= ~mine
                n += 1
    order = np.argsort(-count[:n], kind="stable")
    return centres[order[count[order] >= least][:most]]


def owners(x: np.ndarray) -> list[np.ndarray]:
    """Of each row its centre's row, level by level: within a node the first free row takes all free rows
    within the radius."""
    n = len(x)
    group, out = np.zeros(n, np.int64), []
    for r in RADII:
        near = 1 - r * r / 2  # the cosine at distance r
        own = np.arange(n)
        order = np.argsort(group, kind="stable")
        bounds = np.flatnonzero(np.diff(group[order], prepend=-1))
        for lo, hi in zip(bounds, np.append(bounds[1:], n)):
            if hi - lo == 1:
                continue
            rows = order[lo:hi]
            g = x[rows] @ x[rows].T >= near
            free = np.ones(len(rows), bool)
            for k in np.flatnonzero(g.sum(1) > 1):
                if free[k]:
                    mine = free & g[k]
                    own[rows[mine]] = rows[k]
                    free &= ~mine
        group = own
        out.append(own)
    return out


class Tree:
    """Nested levels over the rows of x: levels[k] = (centres as rows of x, covering radii, parent in levels[k-1])."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, own: list[np.ndarray] | None = None):
        self.x, self.weight = x, weight
        n = len(x)
        self.levels = []
        group = np.zeros(n, np.int64)  # of each row: its node in the level above
        for centre in owners(x) if own is None else own:
            centres, node = np.unique(centre, return_inverse=True)
            self.levels.append([centres, self._radii(centres, node), group[centres]])
            group = node
        self.levels.append([np.arange(n), np.zeros(n), group])
        # level by level: the nodes by parent, and where each parent's start
        self.first = []
        for k in range(len(self.levels)):
            parent = self.levels[k][2]
            count = np.bincount(parent, minlength=len(self.levels[k - 1][0]) if k else 1)
            self.first.append((np.argsort(parent, kind="stable"), np.concatenate([[0], np.cumsum(count)])))
        # level by level: the rows by node, and where each node's start
        self.rows, self.sizes = [None] * len(self.levels), [None] * len(self.levels)
        up = np.arange(n)
        for k in range(len(self.levels) - 1, -1, -1):
            size = np.bincount(up, minlength=len(self.levels[k][0]))
            self.sizes[k] = size
            self.rows[k] = np.argsort(up, kind="stable"), np.concatenate([[0], np.cumsum(size)])
            up = self.levels[k][2][up]

    def members(self, k: int, node: int) -> np.ndarray:
        order, ends = self.rows[k]
        return order[ends[node] : ends[node + 1]]

    def _radii(self, centres, own):
        gap = np.sqrt(((self.x - self.x[centres[own]]) ** 2).sum(1))
        out = np.zeros(len(centres))
        np.maximum.at(out, own, gap)
        return out


def _children(first_a, first_b, p, q, same):
    """Pairs of children of the node pairs p-q, a bounded number at a time; the children of one node pair up once."""
    (order_a, ends_a), (order_b, ends_b) = first_a, first_b
    na, nb = ends_a[p + 1] - ends_a[p], ends_b[q + 1] - ends_b[q]
    total = np.cumsum(na * nb)
    cut = np.unique(np.searchsorted(total, np.arange(0, int(total[-1]) + (1 << 20), 1 << 20))) if len(total) else np.zeros(0, np.int64)
    for lo, hi in zip(np.concatenate([[0], cut]), np.append(cut, len(p))):
        if lo == hi:
            continue
        n = (na * nb)[lo:hi]
        who = np.repeat(np.arange(lo, hi), n)
        at = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        x, y = order_a[ends_a[p[who]] + at // nb[who]], order_b[ends_b[q[who]] + at % nb[who]]
        if same:
            keep = (p[who] != q[who]) | (x <= y)
            x, y = x[keep], y[keep]
        yield x, y


def dual(a: Tree, b: Tree, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(links of a's rows, links of b's rows, i, j): weights of the rows linked to each row, and links i-j
    that connect all that are linked. same: b is a, and a row has no link with itself."""
    far = math.sqrt(2 - 2 * cosine)
    na, nb = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
    ii, jj = [], []
    p, q = np.zeros(1, np.int64), np.zeros(1, np.int64)
    last = len(a.levels) - 1
    for k in range(last + 1):
        ca, ra, _ = a.levels[k]
        cb, rb, _ = b.levels[k]
        found = [_sift(k, last, *t, ra, rb, far, cosine, (a.sizes[k], b.sizes[k])) for t in _widest(a.x[ca], b.x[cb], ra, rb, far, same)] if k == 0 else []
        for x, y in _children(a.first[k], b.first[k], p, q, same) if k else ():
            found.append(_sift(k, last, x, y, _cosines(a.x[ca], b.x[cb], x, y), ra, rb, far, cosine, (a.sizes[k], b.sizes[k])))
        whole = [np.concatenate([f[t] for f in found]) if found else np.zeros(0, np.int64) for t in range(4)]
        for x, y in zip(whole[2], whole[3]):  # node pairs accepted whole
            rows_a, rows_b = a.members(k, x), b.members(k, y)
            if same and x == y:
                na[rows_a] += a.weight[rows_a].sum() - a.weight[rows_a]
                ii.append(np.repeat(rows_a[:1], len(rows_a) - 1))
                jj.append(rows_a[1:])
                continue
            na[rows_a] += b.weight[rows_b].sum()
            nb[rows_b] += a.weight[rows_a].sum()
            ii += [rows_a, np.repeat(rows_a[:1], len(rows_b))]
            jj += [np.repeat(rows_b[:1], len(rows_a)), rows_b]
        p, q = whole[0], whole[1]
        if not len(p):
            break
    else:
        if same:
            keep = p != q
            p, q = p[keep], q[keep]
        np.add.at(na, p, b.weight[q])
        np.add.at(nb, q, a.weight[p])
        ii.append(p)
        jj.append(q)
    if same:
        na, nb = na + nb, nb * 0
    cat = lambda t: np.concatenate(t).astype(np.int64) if t else np.zeros(0, np.int64)
    return na, nb, cat(ii), cat(jj)


def _widest(x, y, rx, ry, far, same):
    """(i, j, cosines) of the first level's pairs that may be near: matrix products, sieved by the farthest that a
    row's pairs may be, in single precision with room for its error; what passes is taken in double. Nodes of
    like radii are sieved together: single vectors, which are most where little clusters, apart from wide ones."""
    x1, y1 = x.astype(np.float32), y.astype(np.float32)
    kind = np.searchsorted(np.array([1e-12, 0.2, 0.35, 0.5, 0.75]), ry)
    for k in np.unique(kind):
        cols = np.flatnonzero(kind == k)
        reach = np.minimum(2.0, far + rx + ry[cols].max() + _EPS)
        least = (1 - reach * reach / 2 - 1e-5).astype(np.float32)
        part = np.ascontiguousarray(y1[cols].T)
        for lo in range(0, len(x), 512):
            hit = np.flatnonzero((x1[lo : lo + 512] @ part >= least[lo : lo + 512, None]).ravel())
            i, j = hit // len(cols) + lo, cols[hit % len(cols)]
            if same:
                keep = i <= j
                i, j = i[keep], j[keep]
            for at in range(0, len(i), 1 << 20):
                own = slice(at, at + (1 << 20))
                yield i[own], j[own], _cosines(x, y, i[own], j[own])


def _cosines(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of the pairs i-j: one matrix product where they fill a rectangle well, else pair by pair."""
    ui, uj = np.unique(i), np.unique(j)
    if len(i) * 8 >= len(ui) * len(uj):
        g = x[ui] @ y[uj].T
        return g[np.searchsorted(ui, i), np.searchsorted(uj, j)]
    out = np.empty(len(i))
    for lo in range(0, len(i), 1 << 16):
        out[lo : lo + (1 << 16)] = np.einsum("nd,nd->n", x[i[lo : lo + (1 << 16)]], y[j[lo : lo + (1 << 16)]])
    return out


def _sift(k, last, x, y, cos, ra, rb, far, cosine, sizes):
    """(open x, open y, accepted x, accepted y)."""
    if k == last:
        hit = cos >= cosine
        none = np.zeros(0, np.int64)
        return x[hit], y[hit], none, none
    gap = np.sqrt(np.maximum(0, 2 - 2 * cos))
    reach = ra[x] + rb[y]
    near = gap <= far + reach + _EPS
    many = sizes[0][x] * sizes[1][y] >= WHOLE  # fewer are as soon compared
    all_in = many & (gap + reach <= far - _EPS)
    near &= ~all_in
    return x[near], y[near], x[all_in], y[all_in]


def _valid(e: Column) -> Column:
    x = F.transform(e, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return e.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))


def _matrix(col) -> np.ndarray:
    flat = col.combine_chunks() if hasattr(col, "combine_chunks") else col
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(flat), -1)


def _centres(points: DataFrame, sample: int, most: int, block_rows: int) -> dict[int, np.ndarray]:
    """By the vectors' length: the centres of the upper levels, nets of radius 1/2 and 1 with so many of the sample about
    them that they promise an eighth of a block."""
    import pyarrow as pa

    longest, n = points.agg(F.max(F.size("x")), F.count("*")).first()
    take = points.orderBy(F.xxhash64(F.lit(3), "h"), "h").limit(max(256, sample * 256 // max(256, longest or 1))).select("x").toArrow().column("x").combine_chunks()
    least = max(2, math.ceil(len(take) * block_rows / 8 / max(1, n)))
    size = take.value_lengths().to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(size):
        x = unit(_matrix(take.filter(pa.array(size == d))))
        found = np.concatenate([net(x, r, most // 2, least) for r in (0.5, 1.0)])
        if len(found):
            out[int(d)] = found
    return out


def _placed(points: DataFrame, table: dict[int, np.ndarray], kind: str) -> DataFrame:
    """points plus dim, centre, ring and gap: the nearest centre of the same length, its distance and the ball
    about it; centre and ring are -1 if none is within 1."""

    def go(batches):
        import pyarrow as pa

        for whole in batches:
            for first in range(0, whole.num_rows, 2048):
                b = whole.slice(first, 2048)
                size = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
                centre, ring, gap = np.full(len(size), -1, np.int64), np.full(len(size), -1, np.int64), np.full(len(size), 2.0)
                for d in np.unique(size):
                    at = np.flatnonzero(size == d)
                    if int(d) in table:
                        cos = unit(_matrix(b.column(2).take(pa.array(at)))) @ table[int(d)].T
                        far = np.sqrt(np.maximum(0, 2 - 2 * cos.max(1)))
                        in_ball = far <= 1
                        at, far, cos = at[in_ball], far[in_ball], cos[in_ball]
                        centre[at], gap[at] = cos.argmax(1), far
                        ring[at] = np.minimum(RINGS - 1, np.floor(-np.log2(np.maximum(far, 1e-9)))).astype(np.int64)
                cols = [pa.array(size.astype(np.int64)), pa.array(centre), pa.array(ring), pa.array(gap)]
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], ["node", "weight", "x", "dim", "centre", "ring", "gap"])

    return points.select("node", "weight", "x").mapInArrow(go, f"node long, weight long, x array<{kind}>, dim long, centre long, ring long, gap double")


def _homes(placed: DataFrame, block_rows: int) -> DataFrame:
    """(dim, centre, ring, home, own, near, far, k): of each ball its upper node (home and own: its centre and ring, or -1
    if it holds too few vectors to be one), the node's least and largest distance from its centre, and its k blocks."""
    sized = placed.groupBy("dim", "centre", "ring").agg(F.count("*").alias("n"), F.min("gap").alias("near"), F.max("gap").alias("far"))
    few = F.col("n") * SMALL < block_rows
    own = sized.select("*", F.when(few, -1).otherwise(F.col("centre")).alias("home"), F.when(few, -1).otherwise(F.col("ring")).alias("own"))
    nodes = own.groupBy("dim", "home", "own").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.ceil(F.sum("n") / block_rows).cast("int").alias("k"))
    return own.drop("n", "near", "far").join(nodes, ["dim", "home", "own"])


def _pair_blocks(homes: DataFrame, table: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """(block, other): block pairs that the upper levels leave open, each in both orders, and own pairs."""
    import pyarrow as pa

    reach = math.sqrt(2 - 2 * cosine) + _ROOM
    nodes = homes.select("dim", "home", "own", "near", "far", "k").distinct()
    wide = {(r["dim"], r["home"]): r["far"] for r in nodes.filter("home >= 0").groupBy("dim", "home").agg(F.max("far").alias("far")).collect()}
    apart = []
    for d, c in table.items():
        r = np.array([wide.get((d, k), -9.0) for k in range(len(c))])
        gap = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
        i, j = np.nonzero(gap <= r[:, None] + r + reach)
        apart.append(pa.table({"d": np.full(len(i), d), "p": i, "q": j, "gap": gap[i, j]}))
    none = pa.table({"d": np.zeros(0, np.int64), "p": np.zeros(0, np.int64), "q": np.zeros(0, np.int64), "gap": np.zeros(0)})
    gaps = nodes.sparkSession.createDataFrame(pa.concat_tables([none, *apart]))
    a, b = nodes.alias("a"), nodes.alias("b")
    # balls of two centres are apart by the centres' distance less both radii, rings of one centre by their gap
    within = (F.col("g.gap") <= F.col("a.far") + F.col("b.far") + reach) & (
        (F.col("g.p") != F.col("g.q")) | ((F.col("a.near") <= F.col("b.far") + reach) & (F.col("b.near") <= F.col("a.far") + reach))
    )
    open_ = a.join(gaps.alias("g"), (F.col("a.dim") == F.col("g.d")) & (F.col("a.home") == F.col("g.p"))).join(
        b, (F.col("b.dim") == F.col("g.d")) & (F.col("b.home") == F.col("g.q")) & within
    )
    loose = a.join(b, (F.col("a.dim") == F.col("b.dim")) & ((F.col("a.home") < 0) | (F.col("b.home") < 0)))
    ends = [F.struct(f"{t}.dim", f"{t}.home", f"{t}.own").alias(t) for t in "ab"] + [F.col("a.k").alias("k"), F.col("b.k").alias("j")]
    parts = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1)).alias("part")
    block = lambda t: F.struct(f"{t}.dim", f"{t}.home", f"{t}.own", "part")
    left = open_.select(*ends).unionByName(loose.select(*ends)).select("a", "b", "j", parts("k")).select(block("a").alias("block"), "b", "j")
    return left.repartition("block").select("block", "b", parts("j")).select("block", block("b").alias("other"))


def embedding_near_dups(table: DataFrame, cosine: float = COSINE, centres: int = CENTRES, block_rows: int = BLOCK_ROWS, sample: int = SAMPLE, report: dict | None = None) -> DataFrame:
    """embeddings -> (vec_id, n_links, component_id, kept), one row per vector.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    vectors of different lengths. Components keep their precision: single stays single, all else is double.
    Equal vectors are compared once and count each. kept: vec_id is the component's least. Repeated vec_ids are
    vectors of their own that share a name. A null vec_id is in a component of that name only if it links with
    nothing named. An empty table gives an empty result; extra columns are ignored. report receives how many
    vectors, blocks and open block pairs there were."""
    kind = "float" if table.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    x = F.col("embedding").cast(f"array<{kind}>")
    rows = table.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.when(_valid(x), x).alias("x"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(5), x).alias("k")
    )
    classes = rows.filter("x IS NOT NULL").groupBy("h", "k").agg(F.first("x").alias("x"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    points = durable(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    top = _centres(points, sample, centres, block_rows)
    placed = durable(_placed(points, top, kind), "placed")
    homes = durable(_homes(placed, block_rows), "homes")
    part = F.pmod(F.xxhash64("node"), F.col("k")).cast("int").alias("part")
    dealt = placed.join(homes, ["dim", "centre", "ring"]).select("node", "weight", "x", F.struct("dim", "home", "own", part).alias("block"))
    pairs = durable(_pair_blocks(homes, top, cosine), "block-pairs")
    def grow(t):
        import pyarrow as pa

        ids = t.column("node").to_numpy()
        own = owners(unit(_matrix(t.column("x"))))
        for k, o in enumerate(own):
            t = t.append_column(f"l{k}", pa.array(ids[o]))
        return t

    names = [f"l{k}" for k in range(len(RADII))]
    kinds = f"node long, weight long, x array<{kind}>, block struct<dim:long,home:long,own:long,part:int>, " + ", ".join(f"{c} long" for c in names)
    grown = durable(dealt.groupBy("block").applyInArrow(grow, kinds), "trees")
    forget(placed, homes)
    if report is not None:
        report |= {"vectors": points.count(), "blocks": grown.select("block").distinct().count(), "open": pairs.filter("block <= other").count()}
    rows_of = ["node", "weight", "x", *names]
    sent = grown.join(pairs, "block").select(*rows_of, "block", "other")
    cells = sent.select(F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") <= F.col("other")).alias("low"), *rows_of)

    def compare(t):
        import pyarrow as pa
        import pyarrow.compute as pc

        def side(s):
            ids = s.column("node").to_numpy()
            order = np.argsort(ids)
            own = [order[np.searchsorted(ids[order], s.column(c).to_numpy())] for c in names]
            return Tree(unit(_matrix(s.column("x"))), s.column("weight").to_numpy(), own), ids

        low, high = t.filter(t.column("low")), t.filter(pc.invert(t.column("low")))
        same = t.column("lo")[0].equals(t.column("hi")[0])
        a, ids_a = side(low)
        b, ids_b = (a, ids_a) if same or not high.num_rows else side(high)
        if same or high.num_rows:
            na, nb, i, j = dual(a, b, cosine, same)
        ids = ids_a if same else np.concatenate([ids_a, ids_b])
        n = na if same else np.concatenate([na, nb])
        hit = np.flatnonzero(n)
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(i):
            order = np.sort(ids)
            u, v = _forest(order, np.searchsorted(order, ids_a[i]), np.searchsorted(order, ids_b[j]))
        return pa.table({
            "u": np.concatenate([ids[hit], u]), "v": pa.array(np.concatenate([ids[hit], v]), mask=np.arange(len(hit) + len(u)) < len(hit)),
            "n": np.concatenate([n[hit], np.zeros(len(u), np.int64)]),
        })

    out = durable(cells.groupBy("lo", "hi").applyInArrow(compare, "u long, v long, n long"), "links")
    forget(grown, pairs)
    counts = out.filter("n > 0").groupBy("u").agg(F.sum("n").alias("n"))
    parts = connected_components(out.filter("v IS NOT NULL").select("u", "v"), "vector-links")
    named = points.select("node", "h", "k", "weight", "least").join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(low, "root").join(counts, named.node == counts.u, "left").select(
        F.col("h").alias("_h"), F.col("k").alias("_k"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), "component_id"
    )
    found = rows.join(of, (rows.h == F.col("_h")) & (rows.k == F.col("_k")) & rows.x.isNotNull(), "left")
    mine = F.coalesce(F.when(F.col("x").isNotNull(), F.col("component_id")), F.col("vec_id"))
    return found.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), mine.alias("component_id"), (F.col("vec_id").eqNullSafe(mine)).alias("kept"))
