"""Quality classifier by co-training of two views.

The content view sees what a text holds: hashed word shapes, hashed words, rates of characters and how the text is laid
out. The metadata view never reads the text: it sees the page's language, source and recorded length. Both start from the
labelled documents; in each round each view scores every unlabelled document, and of the documents that it is sure about
a sample, by class in the proportion of the labels, joins the other view's training set with that pseudo-label. At the
end each view is calibrated on labelled documents held out from all training, and the calibrated log-odds, weighted by
how well each view did there, are added up.

The labelled sample is bounded by `most_labels`, pseudo-labels by `per_round` for each round and view; all unlabelled
documents that a view is sure about have the same chance to be among them, however many there are. Everything else runs
over all documents. Texts are read once: their features are a table, and every score is taken from it. A model is a vector
of at most DIM weights, so it travels with the tasks.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, forget

DIM = 1 << 12
RATES = 8
ROUNDS = 2
#: Labelled documents used, the ones with the least hash of doc_id.
MOST_LABELS = 4_000
PER_ROUND = 400
#: One labelled document in HOLD is held out for calibration.
HOLD = 4


#: A score from which a view is sure: log-odds of 1.
SURE = 1.0

#: Slots of the layout: powers of two of the number of lines, the longest and the mean line, shares of repeated lines, the last sign.
_SIZES, _SHARES, _ENDS = 24, 9, 31
LAYOUT = 3 * _SIZES + _SHARES + _ENDS
_WORDS = RATES + LAYOUT
_HALF = (DIM - _WORDS) // 2
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + _U(1)
_LOWER[65:91] += _U(32)
_CLASS = np.full(256, 4, np.int64)  # letter small, letter large, digit, sign, beyond ASCII
_CLASS[33:127], _CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 3, 0, 1, 2
_power: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, for n places or more."""
    if not _power or len(_power[0]) <= n:
        _power.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, _BLOCK) + 1, base, _U)
            p[0] = 1
            _power.append(np.cumprod(p, dtype=_U))
    return _power[0], _power[1]


def _blocks(raw: bytes):
    """The text's bytes about a megabyte at a time, cut after a space; a word that is longer stays whole."""
    lo = 0
    while lo < len(raw):
        hi = min(len(raw), lo + _BLOCK)
        space = np.flatnonzero(_SPACE[np.frombuffer(raw, np.uint8, hi - lo, lo)]) if hi < len(raw) else []
        if len(space):
            hi = lo + int(space[-1]) + 1
        while hi < len(raw) and not len(space):
            more = min(len(raw), hi + _BLOCK)
            space = np.flatnonzero(_SPACE[np.frombuffer(raw, np.uint8, more - hi, hi)])
            hi = hi + int(space[0]) + 1 if len(space) else more
        yield np.frombuffer(raw, np.uint8, hi - lo, lo)
        lo = hi


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the word in lower case, its form) of every word, from running sums over the bytes."""
    hashes, forms = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for b in _blocks(raw):
        space = _SPACE[b]
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            continue
        up, down = _powers(len(b))
        total = np.concatenate([np.zeros(1, _U), np.cumsum(_LOWER[b] * up[: len(b)], dtype=_U)])
        h = (total[end] - total[start]) * down[start]
        h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
        hashes.append(h ^ (h >> _U(29)))
        k = _CLASS[b]
        last = end - 1
        form = (k[start] * 5 + k[np.minimum(start + 1, last)]) * 5 + k[np.maximum(last - 1, start)]
        forms.append((form * 5 + k[last]) * 16 + np.minimum(end - start, 15))
    return np.concatenate(hashes), np.concatenate(forms)


_UPPER = bytes(range(65, 91))


def content(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rates, layout slots, slots of words and forms, their counts) of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    h, form = _hashed(raw)
    n, chars = max(1, len(h)), max(1, len(raw))
    upper, digit, marks, shouts = (len(raw) - len(raw.translate(None, c)) for c in (_UPPER, b"0123456789", b"#*$%&|<>", b"!?"))
    distinct = len(np.unique(h)) / n
    pairs = len(np.unique(h[1:] * _U(3) + h[:-1])) / max(1, len(h) - 1)
    rates = np.array([upper / chars * 5, digit / chars * 5, marks / chars * 5, shouts / chars * 5, distinct, pairs, min(2.0, chars / n / 10), 1.0])
    lines = raw.split(b"\n")
    power = [min(_SIZES - 1, x.bit_length()) for x in (len(lines), max(map(len, lines)), len(raw) // len(lines))]
    share = int((_SHARES - 1) * len(set(lines)) / len(lines))
    layout = RATES + np.array([*(k * _SIZES + x for k, x in enumerate(power)), 3 * _SIZES + share, 3 * _SIZES + _SHARES + zlib.crc32(raw.rstrip()[-1:]) % _ENDS])
    word, shape = (h % _U(_HALF)).astype(np.int64), form * 40503 % _HALF
    counts = np.bincount(np.concatenate([word + _WORDS, shape + _WORDS + _HALF]), minlength=DIM)
    slots = np.flatnonzero(counts)
    return rates, layout, slots, counts[slots]


def metadata(lang, source, n_chars) -> np.ndarray:
    """Slots of the page's metadata."""
    size = int(n_chars).bit_length() if n_chars is not None else -1
    names = [("lang", lang), ("source", source), ("both", f"{lang} {source}"), ("size", size)]
    return np.array([0] + [1 + zlib.crc32(f"{k}:{v}".encode("utf-8", "surrogatepass")) % (DIM - 1) for k, v in names])


def flat_content(rates, layout, slots, counts, ends) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of the content view's features of many rows. rates and layout: one row each; slots and counts
    of row k: ends[k] .. ends[k + 1]. Values of words and forms have unit length."""
    n = len(rates)
    row = np.repeat(np.arange(n), np.diff(ends))
    value = np.log1p(counts)
    length = np.sqrt(np.bincount(row, value * value, minlength=n))
    value = value / length[row]
    return (
        np.concatenate([np.repeat(np.arange(n), RATES), np.repeat(np.arange(n), layout.shape[1]), row]),
        np.concatenate([np.tile(np.arange(RATES), n), layout.ravel(), slots]),
        np.concatenate([rates.ravel(), np.ones(layout.size), value]),
    )


View = tuple[np.ndarray, np.ndarray, np.ndarray, int]  # row, slot, value; number of rows


def fit(view: View, y: np.ndarray, weight: np.ndarray, steps: int = 250, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression by full-batch Adam on sparse rows: deterministic."""
    row, slot, value, n = view
    w, m, v = np.zeros(DIM), np.zeros(DIM), np.zeros(DIM)
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        d = (1 / (1 + np.exp(-np.clip(score(view, w), -30, 30))) - y) * weight
        g = np.bincount(slot, value * d[row], minlength=DIM) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def score(view: View, w: np.ndarray) -> np.ndarray:
    row, slot, value, n = view
    return np.bincount(row, value * w[slot], minlength=n)


def _rows_of(view: View, keep: np.ndarray) -> View:
    """The rows that keep marks."""
    row, slot, value, _ = view
    at = keep[row]
    return (np.cumsum(keep) - 1)[row[at]], slot[at], value[at], int(keep.sum())


def _stacked(views: list[View]) -> View:
    first = np.cumsum([0] + [v[3] for v in views])
    return (*(np.concatenate(x) for x in ([v[0] + k for v, k in zip(views, first)], [v[1] for v in views], [v[2] for v in views])), int(first[-1]))


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(a, b, skill): a z + b is the log-odds, by Platt's smoothed targets; skill in 0..1 is the share of the
    base rate's log loss that it removes."""
    pos, neg = y.sum(), (1 - y).sum()
    if not pos or not neg:
        return 1.0, 0.0, 1.0
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.array([1.0, 0.0])

    def loss(w):
        m = w[0] * z + w[1]
        return (np.logaddexp(0, m) - goal * m).sum() + 0.005 * ((w[0] - 1) ** 2 + w[1] ** 2)

    for _ in range(50):  # Newton's steps, halved until they help
        p = 1 / (1 + np.exp(-np.clip(w[0] * z + w[1], -30, 30)))
        h = p * (1 - p)
        g = np.array([((p - goal) * z).sum() + 0.01 * (w[0] - 1), (p - goal).sum() + 0.01 * w[1]])
        step = np.linalg.solve(np.array([[(h * z * z).sum() + 0.01, (h * z).sum()], [(h * z).sum(), h.sum() + 0.01]]), g)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        if size <= 1e-6 or np.abs(size * step).max() < 1e-9:
            break
        w = w - size * step
    a, b = w
    p = np.clip(1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))), 1e-6, 1 - 1e-6)
    base = pos / len(y)
    left = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    best = -(base * np.log(base) + (1 - base) * np.log(1 - base))
    return float(max(a, 0)), float(b), float(np.clip(1 - left / best, 0, 1))


_FEATURES = "_id long, _h long, rates array<double>, layout array<short>, slots array<short>, counts array<int>, meta array<short>"


def _features(docs: DataFrame) -> DataFrame:
    """Every document's features of both views; _h is a hash of what they come from."""

    def go(batches):
        import pyarrow as pa

        def lists(rows, kind):
            ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows).astype(kind)))

        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                got = [content(t.as_py() or "") for t in part.column(2)]
                meta = [metadata(*(x.as_py() for x in r)) for r in zip(*(part.column(k) for k in (3, 4, 5)))]
                cols = [lists([g[k] for g in got], t) for k, t in enumerate((np.float64, np.int16, np.int16, np.int32))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols, lists(meta, np.int16)], [f.split()[0] for f in _FEATURES.split(", ")])

    own = [F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars")]
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), *own)
    return rows.select("_id", F.xxhash64("text", "lang", "source", "n_chars").alias("_h"), "text", "lang", "source", "n_chars").mapInArrow(go, _FEATURES)


def _views(t) -> tuple[View, View]:
    """Both views of an Arrow table or batch of features."""
    col = lambda c: x.combine_chunks() if hasattr(x := t.column(c), "combine_chunks") else x
    flat = lambda c: col(c).flatten().to_numpy(zero_copy_only=False)
    n = t.num_rows
    ends = np.concatenate([[0], np.cumsum(col("slots").value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    rates, layout = flat("rates").reshape(n, -1), flat("layout").astype(np.int64).reshape(n, -1)
    meta = flat("meta").astype(np.int64).reshape(n, -1)
    first = flat_content(rates, layout, flat("slots").astype(np.int64), flat("counts"), ends)
    return (*first, n), (np.repeat(np.arange(n), meta.shape[1] if n else 0), meta.ravel(), np.ones(meta.size), n)


def _scored(features: DataFrame, w: list[np.ndarray]) -> DataFrame:
    """(_id, z0, z1) for every document."""

    def go(batches):
        import pyarrow as pa

        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(score(v, x)) for v, x in zip(_views(b), w)]], ["_id", "z0", "z1"])

    return features.drop("_h").mapInArrow(go, "_id long, z0 double, z1 double")


def _one_each(features: DataFrame) -> DataFrame:
    """Of rows that share an id the one with the least hash."""
    cols = [c for c in features.columns if c != "_id"]
    return features.groupBy("_id").agg(F.min(F.struct(*cols)).alias("_one")).select("_id", "_one.*")


def _labelled(features: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Features and label _y of at most so many labelled documents, those with the least hash of doc_id."""
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_y"))
    ids = features.select("_id").join(known, "_id").distinct().withColumn("_order", F.xxhash64(F.lit(1), "_id"))
    # ids are distinct, so the bound holds however often one repeats among the documents
    chosen = ids.orderBy("_order", "_id").limit(most)
    return _one_each(features.join(F.broadcast(chosen.select("_id")), "_id", "left_semi")).join(F.broadcast(chosen), "_id")


def cotrain(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, most_labels: int = MOST_LABELS, per_round: int = PER_ROUND) -> DataFrame:
    """documents, labels(doc_id, quality 0 or 1) -> (doc_id, content, metadata, score, kept), one row per
    document: the calibrated log-odds of either view, the combined probability of quality, and whether it
    is a half or more.

    Labels that are null or neither 0 nor 1 are ignored; a document with both counts as 0. Null texts are
    empty; null metadata is a value of its own. Without labels of both classes every score is a half (and all
    are kept). Repeated rows are scored alike; of rows that share a doc_id but differ, the one with the least hash
    teaches, and each has its own score. An empty table gives an empty result; extra columns are ignored."""
    features = durable(_features(docs), "features")
    sample = _labelled(features, labels, most_labels).toArrow().sort_by([("_order", "ascending"), ("_id", "ascending")])
    y = sample.column("_y").to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        forget(features)
        flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
        return flat.select("doc_id", *[F.lit(0.0).alias(c) for c in ("content", "metadata")], F.lit(0.5).alias("score"), F.lit(True).alias("kept"))
    held = np.arange(len(y)) % HOLD == HOLD - 1
    if y[held].min(initial=2) == y[held].max(initial=-1) or y[~held].min() == y[~held].max() or not held.any():
        held = np.zeros(len(y), bool)  # too few to hold any out
    base = _views(sample)
    train = [_rows_of(v, ~held) for v in base]
    goal = [y[~held].copy() for _ in (0, 1)]
    weight = [np.ones(len(goal[0])) for _ in (0, 1)]
    share = float(y[~held].mean())
    known = labels.select(F.col("doc_id").cast("long").alias("_id")).distinct()
    used: set[tuple[int, int]] = set()
    for turn in range(rounds):
        w = [fit(train[v], goal[v], weight[v]) for v in (0, 1)]
        scored = durable(_scored(features, w).filter("_id IS NOT NULL").join(known, "_id", "left_anti"), "scored")
        each = scored.groupBy("_id").agg(F.min("z0").alias("z0"), F.min("z1").alias("z1"))
        picks = []
        for v in (0, 1):
            for label in (0, 1):
                n = max(1, round(per_round * (share if label else 1 - share)))
                sure = each.filter(F.col(f"z{v}") > SURE if label else F.col(f"z{v}") < -SURE)
                sure = sure.orderBy(F.xxhash64(F.lit(turn), F.lit(v), "_id"), "_id").limit(n)
                picks.append(sure.select("_id", F.lit(v).alias("view"), F.lit(label).alias("label")))
        chosen = picks[0].unionByName(picks[1]).unionByName(picks[2]).unionByName(picks[3])
        ids = sorted((r["_id"], r["view"], r["label"]) for r in chosen.collect())
        forget(scored)
        ids = [i for i in ids if i[:2] not in used]
        used |= {i[:2] for i in ids}
        if not ids:
            break
        wanted = F.broadcast(features.sparkSession.createDataFrame([(i,) for i in sorted({i[0] for i in ids})], "_id long"))
        got = _one_each(features.join(wanted, "_id", "left_semi")).toArrow().sort_by("_id")
        place = {i: k for k, i in enumerate(got.column("_id").to_pylist())}
        for v, view in enumerate(_views(got)):  # what one view is sure of teaches the other
            own = sorted((place[i], label) for i, by, label in ids if by != v)
            mark = np.zeros(got.num_rows, bool)
            mark[[k for k, _ in own]] = True
            train[v] = _stacked([train[v], _rows_of(view, mark)])
            goal[v] = np.append(goal[v], [label for _, label in own])
            weight[v] = np.append(weight[v], np.full(len(own), 0.5))
    w = [fit(train[v], goal[v], weight[v]) for v in (0, 1)]
    test = held if held.any() else ~held
    fits = [calibrate(score(base[v], w[v])[test], y[test]) for v in (0, 1)]
    best = max(f[2] for f in fits)
    prior = float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    odds = [F.lit(a) * F.col(f"z{v}") + F.lit(b) for v, (a, b, _) in enumerate(fits)]
    # each view's evidence over the base rate counts by its skill
    mixed = F.lit(prior) + sum((o - F.lit(prior)) * F.lit(f[2] / best if best else 0.5) for o, f in zip(odds, fits))
    out = _scored(features, w).select(F.col("_id").alias("doc_id"), odds[0].alias("content"), odds[1].alias("metadata"), mixed.alias("mixed"))
    return out.select("doc_id", "content", "metadata", (1 / (1 + F.exp(-F.col("mixed")))).alias("score"), (F.col("mixed") >= 0).alias("kept"))
