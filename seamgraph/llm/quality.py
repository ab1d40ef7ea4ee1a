"""Quality rules with adaptive thresholds from mergeable quantile sketches.

A sketch of a metric is its histogram over buckets that keep four bits below the leading one (values
below 16 are exact), so a quantile is off by a sixteenth of its value at most. Sketches merge by adding
counts: those of a language's sources give the language's, and those of all languages the corpus's. Each
(language, source) takes its fences from its own quantiles, drawn towards its language's, and those towards the
corpus's, as if PRIOR more documents said the same as the wider sketch: a small group follows the wider one, and the
more documents it holds the more it speaks for itself, without a switch at any size. A fence is the median plus REACH times its distance from the lower decile plus the metric's
slack, so what a source usually holds sets its cutoffs and a junk minority cannot move them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, let, packed, words

#: How many documents the wider sketch counts for in a group's quantiles.
PRIOR = 200
REACH = 4
#: Slack of each metric, in its own unit: parts of a thousand, or hundredths of a character for word_length.
SLACK = {"symbols": 20, "capitals": 60, "exclaims": 10, "dup_lines": 350, "repeats": 350, "word_length": 100}
_TEXT = r"[^\x20\x09-\x0D]"


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that the text holds twice or more."""

    def at(k: Column, d: int) -> Column:
        return F.element_at(w, (k + d).cast("int"))

    def of_windows(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            n = F.size(s)
            hash_of = lambda k: F.element_at(s, k.cast("int"))["h"]
            same = lambda k: ((k > 1) & (hash_of(k) == hash_of(F.greatest(k - 1, F.lit(1))))) | ((k < n) & (hash_of(k) == hash_of(F.least(k + 1, n))))
            places = F.sort_array(F.transform(F.filter(F.sequence(F.lit(1), n), same), lambda k: F.element_at(s, k.cast("int"))["p"]))
            covered = F.aggregate(
                places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
                lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"],
            )
            return covered

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), of_sorted)
        )

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda k: F.xxhash64(at(k, 0), at(k, 1), at(k, 2)))
    return F.when(F.size(w) < 3, 0).otherwise(let(hashes, of_windows))


def text_stats(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, capitals, exclaims)."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(_TEXT))
    # a repeat count binds the words once; the other counts of words come with it
    by_words = let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
    ))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("k")))
    return let(F.struct(by_words.alias("w"), by_lines.alias("l")), lambda b: F.struct(
        b["w"]["n_words"].alias("n_words"), b["w"]["word_chars"].alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (b["l"]["n"] - b["l"]["k"]).alias("n_dup_lines"), b["w"]["n_repeat_words"].alias("n_repeat_words"),
        b["l"]["n"].alias("n_lines"),
        F.regexp_count(text, F.lit(r"[A-Z]")).cast("long").alias("n_capitals"), F.regexp_count(text, F.lit(r"[!?]")).cast("long").alias("n_exclaims"),
    ))


def _metrics(s: Column) -> dict[str, Column]:
    def share(a: str, b: str, unit: int) -> Column:
        return F.expr(f"CASE WHEN s.{b} = 0 THEN 0L ELSE (s.{a} * {unit}L) DIV s.{b} END")

    return {
        "symbols": share("n_symbols", "word_chars", 1000), "capitals": share("n_capitals", "word_chars", 1000),
        "exclaims": share("n_exclaims", "word_chars", 1000), "dup_lines": share("n_dup_lines", "n_lines", 1000),
        "repeats": share("n_repeat_words", "n_words", 1000), "word_length": share("word_chars", "n_words", 100),
    }


def _measured(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """keep, s (text_stats), m (metrics), lang and source as _lang and _source."""
    own = docs.select(*keep, F.col("lang").cast("string").alias("_lang"), F.col("source").cast("string").alias("_source"), text_stats(F.col("text")).alias("s"))
    return own.withColumn("m", F.struct(*[c.alias(k) for k, c in _metrics(F.col("s")).items()]))


def _bucket(v: Column) -> Column:
    """v without what lies more than four bits below its leading one."""
    low = F.greatest(F.lit(0), F.length(F.bin(v)) - 5)
    return F.expr("1").cast("long") * F.when(v < 16, v).otherwise(F.call_function("shiftleft", F.call_function("shiftright", v, low), low))


def sketches(measured: DataFrame) -> DataFrame:
    """(_lang, _source, metric, bucket, n) over documents with a word."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), _bucket(F.col("m")[k]).alias("bucket")) for k in SLACK])
    return measured.filter("s.n_words > 0").select("_lang", "_source", F.inline(pairs)).groupBy("_lang", "_source", "metric", "bucket").agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, total, q10, q50) of sketches merged over the other keys."""
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "metric")
    ranked = merged.select(*by, "metric", "bucket", F.sum("n").over(w.orderBy("bucket")).alias("upto"), F.sum("n").over(w).alias("total"))
    first = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("bucket")))
    return ranked.groupBy(*by, "metric").agg(F.first("total").alias("total"), first(10).alias("q10"), first(50).alias("q50"))


def fences(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(_lang, _source, fence): fence is a struct with the largest value that each metric may have."""
    own, lang, top = (_quantiles(sketch, by) for by in (["_lang", "_source"], ["_lang"], []))
    join = own.alias("o").join(lang.alias("l"), F.col("o._lang").eqNullSafe(F.col("l._lang")) & (F.col("o.metric") == F.col("l.metric"))).join(
        top.alias("t"), F.col("o.metric") == F.col("t.metric")
    )

    def pick(c: str) -> Column:
        wide = F.expr(f"(l.total * l.{c} + {prior}L * t.{c}) DIV (l.total + {prior}L)")
        return F.call_function("div", F.col("o.total") * F.col(f"o.{c}") + prior * wide, F.col("o.total") + prior)

    slack = F.coalesce(*[F.when(F.col("o.metric") == k, F.lit(v)) for k, v in SLACK.items()])
    fence = join.select("o._lang", "o._source", "o.metric", (pick("q50") + REACH * (pick("q50") - pick("q10")) + slack).alias("fence"))
    return fence.groupBy("_lang", "_source").agg(F.struct(*[F.max(F.when(F.col("metric") == k, F.col("fence"))).alias(k) for k in SLACK]).alias("fence"))


def _judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed and kept."""
    a, b = measured.alias("a"), limits.alias("b")
    out = a.join(b, F.col("a._lang").eqNullSafe(F.col("b._lang")) & F.col("a._source").eqNullSafe(F.col("b._source")), "left").select("a.*", "b.fence")
    failed = (F.col("s.n_words") < 50) | (100 * F.col("s.n_repeat_words") > 50 * F.col("s.n_words"))
    within = F.lit(True)
    for k in SLACK:
        within = within & (F.col("m")[k] <= F.col("fence")[k])
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(within, F.lit(False)))


def quality_rules(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """documents -> (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept),
    one row per document.

    Null and empty texts have no words and fail the base rules. Null languages and sources are groups of
    their own. Repeated rows are judged alike. An empty table gives an empty result; extra columns are
    ignored."""
    measured = durable(_measured(docs, [F.col("doc_id").cast("long").alias("doc_id")]), "measured")
    limits = durable(fences(sketches(measured), prior), "fences")
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return _judged(measured, limits).select("doc_id", *[F.col("s")[c].alias(c) for c in cols], "base_failed", "kept")


def quality_filter(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """The documents that the rules keep, with docs' columns. Each text is measured once: the measures are written
    beside the rows, and the verdict is joined to them."""
    cols = docs.columns
    measured = durable(_measured(docs, [packed(docs)]), "measured")
    limits = durable(fences(sketches(measured), prior), "fences")
    return _judged(measured, limits).filter("kept").select(*[F.col("_row")[c].alias(c) for c in cols])
