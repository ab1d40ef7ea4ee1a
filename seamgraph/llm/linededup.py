"""Line dedup by winnowing over line hashes.

A document's units are its lines that hold a word (others are neither compared nor removed). Of every
window of MIN_RUN consecutive units the one with the least hash, the first such, is chosen; what some window
chose is a fingerprint, and only fingerprints are kept, one row for each place. Any run of MIN_RUN units that
two places share thus has a fingerprint in common, at the same distance from its start. Fingerprints that
occur once end the search there. From those that repeat, matches are extended both ways, by as many units to
the left and to the right as the windows that chose them reach: places whose extensions agree word for word
(by 128-bit names) hold the same run, and those after the first, in the order of doc_id, are later repeats.
Longer runs are covered by the extensions of their fingerprints, so the union is every maximal repeated run,
and its lines go. A fingerprint alone removes nothing.

With min_words, shorter runs that hold so many words are repeats too: they are windows of their own, with
their own minima, so documents of fewer than MIN_RUN units are compared as well.

Positions are joined with the first place alone, never with each other, so a line that every document holds
costs as many rows as it has places; hot fingerprints and hot extensions travel to the rows instead of
meeting in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, forget, let, met, n_words, packed, row_hash

#: Least length of a run, in lines that hold a word.
MIN_RUN = 3
#: Least number of words of a shorter run, where those count.
MIN_WORDS = 50


def _unit(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def fingerprints(docs: DataFrame, min_run: int, min_words: int | None) -> DataFrame:
    """(id, h, print, ways): one row per chosen unit and document. ways: for every window that chose it, the lines
    of the window's first and last units and the 128-bit name of the content between."""

    def line(x: Column, i: Column) -> Column:
        words = [] if min_words is None else [F.when(_unit(x), n_words(x)).alias("n")]
        return F.struct(i.alias("i"), F.when(_unit(x), F.xxhash64(x)).alias("p"), F.when(_unit(x), F.xxhash64(F.lit(11), x)).alias("q"), *words)

    units = F.filter(F.transform(F.split("text", "\n", -1), line), lambda u: u["p"].isNotNull())

    def marks(u: Column) -> Column:
        own = lambda k, d, f: F.element_at(u, (k + d).cast("int"))[f]

        def way(k: Column, run: int, left: int) -> Column:
            """The window of `run` units with `left` of them before unit k, if it lies in the text and chose k."""
            around = [d for d in range(-left, run - left) if d]
            least = F.lit(True)
            for d in around:
                least = least & ((own(k, d, "p") > own(k, 0, "p")) if d < 0 else (own(k, d, "p") >= own(k, 0, "p")))
            if run < min_run:
                least = least & (sum((own(k, d, "n") for d in around), own(k, 0, "n")) >= min_words)
            p, q = ([own(k, d, f) for d in range(-left, run - left)] for f in "pq")
            extended = F.struct(
                own(k, -left, "i").alias("at"), own(k, run - left - 1, "i").alias("to"), F.xxhash64(*p).alias("a"), F.xxhash64(F.lit(5), *q, *p).alias("b")
            )
            inside = (k > left) & (k + (run - left - 1) <= F.size(u))
            return F.when(inside, F.when(least, extended))

        runs = range(min_run if min_words is None else 1, min_run + 1)
        every = [(run, left) for run in runs for left in range(run)]

        def mark(k: Column) -> Column:
            return F.struct(own(k, 0, "p").alias("print"), F.array_compact(F.array(*[way(k, *e) for e in every])).alias("ways"))

        some = F.when(F.size(u) > 0, F.sequence(F.lit(1), F.size(u))).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(some, mark), lambda m: F.size(m["ways"]) > 0)

    return docs.select("id", "h", F.inline(let(units, marks)))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "h": F.xxhash64(text), "text": text})


def repeated_runs(docs: DataFrame, min_run: int = MIN_RUN, min_words: int | None = None) -> DataFrame:
    """(id, h, runs): for documents that lose lines, the line ranges (at, to) whose units go. (id, h) is
    doc_id, 0 for null, and the text's hash."""
    marks = durable(fingerprints(_keyed(docs.select("doc_id", "text")), min_run, min_words), "fingerprints")
    again = durable(marks.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1"), "again")
    live = durable(met(marks, again, ["print"], "n", marks.count()).select("id", "h", F.inline("ways")), "live")
    forget(marks, again)
    place = F.struct("id", "h", "at")
    first = live.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).filter("first < last")
    first = durable(first.drop("last"), "first")
    later = met(live, first, ["a", "b"], "n", live.count()).filter(place > F.col("first"))
    runs = durable(later.groupBy("id", "h").agg(F.collect_set(F.struct("at", "to")).alias("runs")), "runs")
    forget(live, first)
    return runs


def _repeated_rows(docs: DataFrame) -> DataFrame:
    """(id, h, n): how many rows hold the same doc_id and text, where more than one does."""
    return durable(_keyed(docs.select("doc_id", "text")).groupBy("id", "h").agg(F.count("*").alias("n")).filter("n > 1"), "rows")


def line_dedup(docs: DataFrame, min_run: int = MIN_RUN, min_words: int | None = None) -> DataFrame:
    """docs -> its columns with the repeated lines gone from text, and n_lines, n_removed (long).

    Lines are what "\n" separates, compared whole. A run is of min_run lines or more, lines without a word
    not counted, or of fewer that hold min_words words together, if given; its first place, least by doc_id
    (null as 0), text hash and line, stays. Of rows that repeat doc_id and text one (by a hash of all columns) is
    that place, the others are later repeats of all that can repeat. A null text stays null, with no lines; an
    empty one has one line. A document may lose all its lines: its text is then empty. An empty table
    gives an empty result. Other columns pass; own n_lines and n_removed columns are replaced."""
    cols = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("h")]
    rows = docs.select(packed(docs, cols), *key, row_hash(docs))
    repeats = _repeated_rows(docs)
    first = F.lit(True).alias("first")
    if repeats.isEmpty():
        forget(repeats)
        rows = rows.select("_row", "id", "h", first)
    else:
        nth = F.row_number().over(Window.partitionBy("id", "h").orderBy("row_hash")) == 1
        rows = rows.join(repeats, ["id", "h"], "left_semi").select("_row", "id", "h", nth.alias("first")).unionByName(
            rows.join(repeats, ["id", "h"], "left_anti").select("_row", "id", "h", first)
        )
    # runs grow with the input: never broadcast, so that the plan is the same at every size
    out = rows.join(repeated_runs(docs, min_run, min_words).hint("merge"), ["id", "h"], "left")
    raw = F.col("_row.text").cast("string")

    def cut(lines: Column) -> Column:
        """(text, n): the text without the runs' units, and how many those are."""
        at = lambda i: F.element_at(lines, i + 1)
        every = F.sequence(F.lit(0), F.size(lines) - 1)
        units = F.filter(every, lambda i: _unit(at(i)))
        of_runs = F.array_distinct(F.flatten(F.transform(F.coalesce("runs", F.array()), lambda r: F.sequence(r["at"], r["to"]))))
        whole = F.size(units) >= min_run
        if min_words is not None:
            whole = whole | (F.aggregate(F.transform(units, lambda i: n_words(at(i))), F.lit(0).cast("long"), lambda x, y: x + y) >= min_words)
        gone = F.when(F.col("first"), F.filter(of_runs, lambda i: _unit(at(i)))).when(whole, units).otherwise(F.array().cast("array<int>"))
        left = F.array_except(every, gone)
        return F.struct(F.array_join(F.transform(left, at), "\n").alias("text"), F.size(gone).cast("long").alias("n"))

    untouched = F.struct(raw.alias("text"), F.lit(0).cast("long").alias("n"))
    cut_text = F.when((F.col("runs").isNull() & F.col("first")) | raw.isNull(), untouched).otherwise(let(F.split(raw, "\n", -1), cut))
    n_lines = F.when(raw.isNull(), 0).otherwise(F.length(raw) - F.length(F.replace(raw, F.lit("\n"), F.lit(""))) + 1)
    return out.select("_row", cut_text.alias("_cut"), n_lines.cast("long").alias("n_lines")).select(
        *[F.col("_cut.text").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in cols], "n_lines", F.col("_cut.n").alias("n_removed")
    )
