"""Exact substring dedup by recompression: every window of WINDOW words that starts at two places or more goes.

1. Equal texts are one, with their number. Rounds of recompression (see recompress.py) name runs and pairs: a first
   parse within each text up to a third of a window, then Spark rounds that triple the symbols' greatest length until
   it is sixteen windows. Each round's new names are counted over the whole corpus, and the table of those that occur
   at two places or more decides what goes on: shared symbols pair up in the next round, symbols that occur once
   become fences. A window that covers the context of a symbol that occurs once occurs once itself and is settled.
2. Shared symbols reveal repeats: those as long as a window are matched by their 128-bit names, and where a name has
   a second place, all windows inside it are repeats, at all its places; its first place speaks for them.
3. What is left lies at the edges of repeats, where no symbol that reaches over the edge is shared. These windows are
   verified by their words: in blocks, then one by one, against each other and against those that speak.

Only names and places are exchanged, by partial counts; hot names travel to the rows instead of meeting in one task, so
a passage in a third of all documents costs as many rows as it has places. Finished steps are written to the shared
folder, which also releases their shuffle files.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, forget, met
from .recompress import FENCE, FRESH, SHARED, Parse, U, stir, window_hashes, word_hashes

WINDOW = 35
#: Rounds within a text before the first count, and rounds between two counts.
FIRST_ROUNDS, ROUNDS = 6, 3
#: A symbol's greatest length, in windows, at which rounds end: longer repeats are met at the seams of such symbols.
REACH = 16
#: How much longer symbols may be at each count.
GROWTH = 3
#: Words that a worker parses at a time; a longer text is parsed alone.
AT_ONCE = 250_000
#: Low bits of a packed place: the symbol's ordinal among its text's new ones. Later ones are taken as shared.
ORD = (1 << 24) - 1
#: A block ends before a window whose first word's hash has these bits clear.
_CUT = U(3)

_KEY = ["h1", "h2"]
_RUNS = "array<struct<at:int,n:int>>"
_STATE = (
    "h1 long, h2 long, m long, n int, a array<long>, b array<long>, start array<int>, size array<int>, before array<int>, after array<int>, "
    f"first array<short>, last array<short>, kind array<byte>, once {_RUNS}, grams array<struct<a:long,b:long,at:int,n:int>>"
)
_NAMES = [f.split()[0] for f in _STATE.replace(_RUNS, "x").replace("array<struct<a:long,b:long,at:int,n:int>>", "x").split(", ")]


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, text): rows with equal keys hold equal texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(5), text).alias("h2"), text.alias("text"))


def _groups(texts):
    """(first row, hashes of the rows' words), about AT_ONCE words at a time."""
    own, total, lo = [], 0, 0
    for k, t in enumerate(texts):
        h = word_hashes(t.as_py())
        if own and total + len(h[0]) > AT_ONCE:
            yield lo, own
            own, total, lo = [], 0, k
        own.append(h)
        total += len(h[0])
    if own:
        yield lo, own


def _list(values: np.ndarray, row: np.ndarray, rows: int):
    """An Arrow list column of values, which belong to ascending rows."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32), values if isinstance(values, pa.Array) else pa.array(values))


def _flat(col, *fields: str):
    """(values of a list column, rows they belong to); of a list of structs, the fields' values."""
    import pyarrow as pa

    ends = col.offsets.to_numpy().astype(np.int64)
    values = col.values.slice(ends[0], ends[-1] - ends[0])
    row = np.repeat(np.arange(len(col)), np.diff(ends))
    take = lambda v: v.to_numpy(zero_copy_only=False)
    if isinstance(values, pa.StructArray):
        return *[take(f) for f in values.flatten()], row
    return take(values), row


def _struct(**columns):
    import pyarrow as pa

    return pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _state(keys, p: Parse, once, grams):
    """A record batch of _STATE. keys: h1, h2, m, n; once and grams: their fields and rows."""
    import pyarrow as pa

    rows = len(keys[0])
    i64 = lambda x: x.view(np.int64)
    lists = [
        i64(p.a), i64(p.b), p.start.astype(np.int32), (p.end - p.start).astype(np.int32), (p.start - p.lo).astype(np.int32),
        (p.hi - p.end).astype(np.int32), p.first, p.last, p.kind,
    ]
    at, n, owner = once
    a, b, g_at, g_n, g_owner = grams
    return pa.RecordBatch.from_arrays(
        [*keys, *[_list(x, p.row, rows) for x in lists],
         _list(_struct(at=at.astype(np.int32), n=n.astype(np.int32)), owner, rows),
         _list(_struct(a=i64(a), b=i64(b), at=g_at.astype(np.int32), n=g_n.astype(np.int32)), g_owner, rows)],
        _NAMES,
    )


_NONE = np.zeros(0, np.int64)


def _first_parse(texts: DataFrame, longest: int) -> DataFrame:
    def go(batches):
        import pyarrow as pa

        for batch in batches:
            for first, own in _groups(batch.column(3)):
                part = batch.slice(first, len(own))
                p = Parse.of_words(own).rounds(0, FIRST_ROUNDS, longest)
                n = np.array([len(a) for a, _ in own], np.int32)
                keys = [part.column(0), part.column(1), part.column(2), pa.array(n)]
                none = (_NONE, _NONE, _NONE)
                yield _state(keys, p, none, (_NONE.view(U), _NONE.view(U), *none))

    return texts.select("h1", "h2", "m", "text").mapInArrow(go, _STATE)


def _merged(at: np.ndarray, n: np.ndarray, row: np.ndarray):
    """The union of runs (at .. at + n - 1 of each row) as ascending runs with gaps between."""
    if not len(at):
        return _NONE, _NONE, _NONE
    base = int((at + n).max()) + 2 - min(0, int(at.min()))
    lo = row.astype(np.int64) * base + at
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], (lo + n)[order]
    top = np.maximum.accumulate(hi)
    head = np.ones(len(lo), bool)
    head[1:] = lo[1:] > top[:-1]
    s = np.flatnonzero(head)
    lo, hi = lo[s], top[np.append(s[1:], len(top)) - 1]
    return lo % base, hi - lo, lo // base


def _next_parse(state: DataFrame, size: int, done: int, longest: int | None) -> DataFrame:
    """state with `again` (ordinals of the new symbols that are shared) -> the next state: new symbols that occur
    once settle windows, shared ones as long as a window are kept as grams, and the shared ones go through more
    rounds, if `longest` is given."""

    def go(batches):
        for whole in batches:
            sizes = np.diff(whole.column(4).offsets.to_numpy())
            cut = np.unique(np.append(np.searchsorted(np.cumsum(sizes, dtype=np.int64), np.arange(0, int(sizes.sum()) + 1, AT_ONCE)), [0, whole.num_rows]))
            for lo_row, hi_row in zip(cut[:-1], cut[1:]):
                yield step(whole.slice(lo_row, hi_row - lo_row))

    def step(t):
        keys = [t.column(k) for k in range(4)]
        n = keys[3].to_numpy(zero_copy_only=False).astype(np.int64)
        (a, row), (b, _), (start, _), (width, _), (before, _), (after, _), (first, _), (last, _), (kind, _) = (_flat(t.column(k)) for k in range(4, 13))
        p = Parse(row=row, a=a.view(U), b=b.view(U), start=start, end=start + width, lo=start - before, hi=start + width + after, first=first, last=last, kind=kind.copy())
        fresh = np.flatnonzero(p.kind == FRESH)
        count = np.bincount(row, minlength=len(n))
        head = np.cumsum(count) - count
        again, doc = _flat(t.column(15).fill_null([]))
        shared = np.arange(len(row)) - head[row] >= ORD
        ok = again < count[doc]  # others belong to a text that shares the key's upper bits
        shared[head[doc[ok]] + again[ok]] = True
        known = shared[fresh]
        p.kind[fresh] = np.where(known, SHARED, FENCE)
        alone, shared = fresh[~known], fresh[known]
        # a context that reaches over the text's border lies in no window
        alone = alone[(p.lo[alone] >= 0) & (p.hi[alone] <= n[row[alone]]) & (p.hi[alone] - p.lo[alone] <= size)]
        least = np.maximum(0, p.hi[alone].astype(np.int64) - size)
        at, count, owner = _flat(t.column(13), "at", "n")
        once = _merged(np.concatenate([at, least]), np.concatenate([count, p.lo[alone] - least + 1]), np.concatenate([owner, row[alone]]))
        g = shared[p.end[shared] - p.start[shared] >= size]
        ga, gb, g_at, g_n, g_row = _flat(t.column(14), "a", "b", "at", "n")
        rows = np.concatenate([g_row, row[g]])
        order = np.argsort(rows, kind="stable")
        grams = [
            np.concatenate(x)[order]
            for x in ((ga.view(U), p.a[g]), (gb.view(U), p.b[g]), (g_at, p.start[g]), (g_n, p.end[g] - p.start[g] - size + 1))
        ]
        p = p.take(p.growing() if longest else _NONE)
        if longest:
            p.rounds(done, ROUNDS, longest)
        return _state(keys, p, once, (*grams, rows[order]))

    return state.select(*_NAMES, "again").mapInArrow(go, _STATE)




def _texts(docs: DataFrame) -> DataFrame:
    """(h1, h2, m, text): each text once, with the number of rows that hold it."""
    return _keyed(docs).groupBy(*_KEY).agg(F.count("*").alias("m"), F.first("text").alias("text"))


def _shared_names(state: DataFrame) -> DataFrame:
    """(high, again): the round's table of names, those with two places or more in the corpus, as the ordinals of
    every text's new symbols that have them."""
    high = F.col("h1").bitwiseAND(F.lit(~ORD)).alias("high")
    asked = state.select(high, "m", "kind", F.posexplode("a").alias("nth", "name")).filter(F.get("kind", F.col("nth")) == int(FRESH)).drop("kind")
    names = asked.groupBy("name").agg(F.sum("m").alias("n"), F.count("*").alias("k")).filter("n > 1").select("name", "k")
    names = durable(names, "names")
    total = state.agg(F.sum(F.size(F.filter("kind", lambda k: k == int(FRESH))))).first()[0] or 0
    places = asked.filter(F.col("nth") < ORD).select("name", F.col("high").bitwiseOR(F.col("nth")).alias("place"))
    places = met(places, names, ["name"], "k", total).select("place")
    again = places.groupBy(F.col("place").bitwiseAND(F.lit(~ORD)).alias("high"))
    out = durable(again.agg(F.collect_list(F.col("place").bitwiseAND(F.lit(ORD)).cast("int")).alias("again")), "again")
    forget(names)
    return out


def _recompressed(texts: DataFrame, size: int) -> DataFrame:
    """(h1, h2, m, n, once, grams) of every text after all rounds: windows (at, n) that occur once, and shared symbols
    as long as a window (name a b, its windows at, n)."""
    longest = max(3, size // 3)
    state, done = durable(_first_parse(texts, longest), "parse"), FIRST_ROUNDS
    while True:
        again = _shared_names(state)
        high = F.col("h1").bitwiseAND(F.lit(~ORD)).alias("high")
        longest = longest * GROWTH if longest < REACH * size else None
        new = durable(_next_parse(state.select("*", high).join(again, "high", "left"), size, done, longest), "parse")
        forget(state, again)
        state, done = new, done + ROUNDS
        if longest is None:
            return state


def _revealed(state: DataFrame, size: int) -> DataFrame:
    """state -> (h1, h2, n, settled, speak, open): windows (at, n) that repeats hold, those of them for which this
    place speaks, and windows that nothing settles. A text that several rows hold is one gram as a whole."""
    fits = F.col("n") >= size
    whole = F.array(F.struct(F.col("h1").alias("a"), F.col("h2").alias("b"), F.lit(0).alias("at"), (F.col("n") - size + 1).alias("n")))
    # whole texts, by their hashes, have names of their own
    mine = F.when(fits & (F.col("m") > 1), whole).otherwise(F.col("grams"))
    named = durable(state.select(*_KEY, (F.col("m") > 1).alias("sure"), F.inline(mine)).withColumnRenamed("n", "len"), "grams")
    first = F.min(F.struct("h1", "h2", "at")).alias("speaker")
    counted = durable(named.groupBy("a", "b").agg(F.count("*").alias("k"), first, F.max("sure").alias("any")).filter("k > 1 OR any").drop("any"), "counted")
    found = met(named, counted, ["a", "b"], "k", named.count())
    speaks = F.col("speaker") == F.struct("h1", "h2", "at")
    runs = found.groupBy(*_KEY).agg(F.collect_list(F.struct("at", F.col("len").alias("n"), speaks.alias("speaks"))).alias("found"))
    joined = state.select(*_KEY, "n", "once").join(runs, _KEY, "left")

    def go(batches):
        for t in batches:
            words = t.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            at, n, row = _flat(t.column(3), "at", "n")
            f_at, f_n, speaks, f_row = _flat(t.column(4).fill_null([]), "at", "n", "speaks")
            settled = _merged(f_at, f_n, f_row)
            top = _outermost(f_at, f_n, f_row)
            top = top[speaks[top]]
            speak = _merged(f_at[top], f_n[top], f_row[top])
            known = _merged(*(np.concatenate([x, y]) for x, y in zip((at, n, row), settled)))
            yield _runs_batch(t, settled, speak, _gaps(*known, words - size + 1))

    schema = f"h1 long, h2 long, n int, settled {_RUNS}, speak {_RUNS}, open {_RUNS}"
    out = durable(joined.mapInArrow(go, schema), "revealed")
    forget(named, counted)
    return out


def _outermost(at: np.ndarray, n: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The runs that lie in no other of their row (of equal ones, the first)."""
    order = np.lexsort((-n, at, row))
    if not len(order):
        return order
    base = int((at + n).max()) + 1
    end = row[order].astype(np.int64) * base + (at + n)[order]
    before = np.concatenate([[-1], np.maximum.accumulate(end)[:-1]])
    return order[end > before]


def _gaps(at: np.ndarray, n: np.ndarray, row: np.ndarray, many: np.ndarray):
    """What the ascending, separate runs leave of the places 0 .. many - 1 of each row."""
    rows = np.arange(len(many))
    lo = np.concatenate([np.zeros(len(many), np.int64), at + n])
    hi_row = np.concatenate([rows, row])
    order = np.lexsort((lo, hi_row))
    lo, owner = lo[order], hi_row[order]
    # each gap ends where the row's next run starts, or at the row's end
    ends_row = np.concatenate([row, rows])
    ends = np.concatenate([at, np.maximum(many, 0)])
    order = np.lexsort((ends, ends_row))
    hi = ends[order]
    keep = hi > lo
    return lo[keep], (hi - lo)[keep], owner[keep]


def _runs_batch(t, *lists):
    import pyarrow as pa

    rows = t.num_rows
    cols = [_list(_struct(at=at.astype(np.int32), n=n.astype(np.int32)), row, rows) for at, n, row in lists]
    return pa.RecordBatch.from_arrays([t.column(0), t.column(1), t.column(2), *cols], ["h1", "h2", "n", "settled", "speak", "open"])


def _named_blocks(texts: DataFrame, size: int) -> DataFrame:
    """texts with runs `open` and `speak` -> (ga, gb, h1, h2, at, own, a, b): the runs' windows in blocks, with the
    blocks' names, whether they are open, and the windows' names. Blocks are cut by the words' hashes, so repeats are
    cut alike but at their ends."""

    def go(batches):
        import pyarrow as pa

        for batch in batches:
            for first, own in _groups(batch.column(2)):
                part = batch.slice(first, len(own))
                n = np.array([len(a) for a, _ in own], np.int64)
                start = np.concatenate([[0], np.cumsum(n)])
                wa, wb = (np.concatenate([x[k] for x in own]) for k in (0, 1))
                (o_at, o_n, o_row), (s_at, s_n, s_row) = (_flat(part.column(k).fill_null([]), "at", "n") for k in (3, 4))
                at, count, row = (np.concatenate(x).astype(np.int64) for x in ((o_at, s_at), (o_n, s_n), (o_row, s_row)))
                if not len(at):
                    continue
                is_open = np.arange(len(at)) < len(o_at)
                run = np.repeat(np.arange(len(at)), count)
                head = np.cumsum(count) - count
                w = (at + start[row])[run] + np.arange(len(run)) - head[run]
                cut = (wa[w] & _CUT) == 0
                cut[head] = True
                s = np.flatnonzero(cut)
                e = np.append(s[1:], len(w))
                # a block's first and last windows name all its words: it holds no more windows than a window words
                more = -(-(e - s) // size)
                which = np.repeat(np.arange(len(s)), more)
                s2 = s[which] + size * (np.arange(len(which)) - np.repeat(np.cumsum(more) - more, more))
                e2 = np.minimum(e[which], s2 + size)
                a, b = window_hashes(wa, wb, w, size)
                many = (e2 - s2).astype(U)
                ga, gb = stir(a[s2] + stir(a[e2 - 1] + many)), stir(b[s2] + stir(b[e2 - 1] ^ stir(many)))
                bounds = np.append(s2, len(w)).astype(np.int32)
                doc = row[run[s2]]
                keys = part.select([0, 1]).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ga.view(np.int64)), pa.array(gb.view(np.int64)), keys.column(0), keys.column(1),
                     pa.array((w[s2] - start[doc]).astype(np.int32)), pa.array(is_open[run[s2]]),
                     *[pa.ListArray.from_arrays(bounds, x.view(np.int64)) for x in (a, b)]],
                    ["ga", "gb", "h1", "h2", "at", "own", "a", "b"],
                )

    schema = "ga long, gb long, h1 long, h2 long, at int, own boolean, a array<long>, b array<long>"
    return texts.select(*_KEY, "text", "open", "speak").mapInArrow(go, schema)


def repeated_windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(h1, h2, runs): for texts with repeats, ranges (at, n): windows that start at words at .. at + n - 1."""
    texts = durable(_texts(docs), "texts")
    state = _recompressed(texts, size)
    shown = _revealed(state, size)
    forget(state)
    ask = shown.filter((F.size("open") > 0) | (F.size("speak") > 0)).select(*_KEY, "open", "speak")
    blocks = durable(_named_blocks(texts.join(ask, _KEY), size), "blocks")
    forget(texts)
    place = F.struct("h1", "h2", "at")
    counted = blocks.groupBy("ga", "gb").agg(F.count("*").alias("k"), F.min(place).alias("speaker")).filter("k > 1")
    counted = durable(counted, "counted")
    joined = met(blocks, counted, ["ga", "gb"], "k", blocks.count(), "left")
    speaks = F.col("speaker").isNull() | (F.col("speaker") == place)
    judged = durable(joined.select(
        "h1", "h2", "at", "own", F.size("a").alias("n"), F.col("speaker").isNotNull().alias("settled"),
        F.when(speaks, F.arrays_zip("a", "b")).alias("windows"),
    ), "judged")
    forget(blocks, counted)
    windows = judged.filter("windows IS NOT NULL").select(*_KEY, "at", F.expr("own AND NOT settled").alias("ask"), F.posexplode("windows").alias("k", "w")).select(
        *_KEY, (F.col("at") + F.col("k")).alias("at"), "ask", F.col("w.a").alias("a"), F.col("w.b").alias("b")
    )
    again = windows.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("ask").alias("any")).filter("n > 1 AND any").select("a", "b", "n")
    again = durable(again, "windows")
    total = judged.filter("windows IS NOT NULL").agg(F.sum("n")).first()[0] or 0
    singles = met(windows.filter("ask"), again, ["a", "b"], "n", total).select(*_KEY, "at", F.lit(1).alias("n"))
    runs = judged.filter("own AND settled").select(*_KEY, "at", "n").unionByName(singles).unionByName(shown.select(*_KEY, F.inline("settled")))
    out = durable(runs.groupBy(*_KEY).agg(F.collect_list(F.struct("at", "n")).alias("runs")), "runs")
    forget(shown, judged, again)
    return out


def substring_dedup(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """documents -> (doc_id, n_words, n_removed, kept), one row per document: the words that no repeated
    window covers, joined by one space.

    A repeat counts wherever it starts, in the same document too, and all its places go. Windows never
    cross documents. Null and empty texts have no words; texts are never cut; rows that repeat doc_id and
    text are documents of their own (and so repeat each other); an empty table gives an empty result;
    extra columns are ignored."""
    runs = repeated_windows(docs, size)
    joined = _keyed(docs).join(runs, _KEY, "left")

    def go(batches):
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                total, gone, kept = [], [], []
                for text, runs in zip(part.column(1), part.column(2)):
                    w = text.as_py().encode("utf-8", "surrogatepass").split()
                    total.append(len(w))
                    if runs.is_valid:
                        own = runs.values
                        at = own.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
                        n = own.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
                        change = np.zeros(len(w) + 1, np.int64)
                        np.add.at(change, at, 1)
                        np.add.at(change, at + n - 1 + size, -1)
                        left = np.cumsum(change[:-1]) <= 0
                        w = [w[k] for k in np.flatnonzero(left)]
                    gone.append(total[-1] - len(w))
                    kept.append(b" ".join(w).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.select("doc_id", "text", "runs").mapInArrow(go, "doc_id long, n_words long, n_removed long, kept string")
