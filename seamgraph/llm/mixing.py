"""Mixing sources to target weights along a time-varying curriculum.

Each source s has a weight that changes over training time t in [0, 1]: w_s(t) = w_s (1 + a_s (2 t - 1)).
Its integral is w_s, so the source's demand by time t is D_s(t) = T_s ((1 - a_s) t + a_s t^2), T_s being
its target in words. The source's documents, in a fixed random order, form a stream that is repeated
until T_s words are taken; the word at offset c of the stream is trained on at D_s^-1(c), and the
position of that time in the whole mix is the sum of all sources' demand by then.

Offsets come from a two-level prefix sum: documents fall into hash buckets of their source, so the
running sum needs one window over a source's buckets (at most BUCKETS rows) and one over a bucket's
documents; a source with a third of all rows is spread over all its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, forget, n_words, packed, row_hash, words

#: Weights by the rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: Slopes of the weight schedules by the rank of the source, repeating: 1 grows from nothing, -1 fades to nothing.
SLOPES = (-0.5, 0.0, 0.5)
#: No source is taken more often than this.
MOST = 3
#: Hash buckets of each source.
BUCKETS = 4096


def _ranked(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds rank: 0 for the least key. Each range partition ranks its own rows; the partitions' sizes,
    one row for each, shift them. Also the table that the result reads."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = durable(sources.repartitionByRange(n, "s").withColumn("range", F.spark_partition_id()), "ranges")
    before = dealt.groupBy("range").agg(F.count("*").alias("n")).select(
        "range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before")
    )
    own = F.row_number().over(Window.partitionBy("range").orderBy("s")) - 1
    out = dealt.withColumn("own", own).join(before, "range").withColumn("rank", F.col("before") + F.col("own"))
    return out.drop("range", "own", "before"), dealt


def _by_rank(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))


def _targets(sizes: DataFrame, weights: tuple, slopes: tuple, most: int) -> DataFrame:
    """sizes(s, size) -> (s, source_size, slope, target): all words are shared by weight; a source stops
    at `most` times its size and the excess is shared again until none is above."""
    sources = durable(sizes.groupBy("s").agg(F.sum("size").alias("source_size")), "sources")
    ranked, dealt = _ranked(sources)
    per = durable(
        ranked.select("s", "source_size", _by_rank(weights, F.col("rank")).alias("weight"), _by_rank(slopes, F.col("rank")).alias("slope")), "ranked"
    )
    forget(sources, dealt)
    total = per.agg(F.sum("source_size")).first()[0] or 0
    unit, stopped = 0.0, -1
    cap = F.col("source_size") * most
    while True:  # each pass but the last stops at least one more source
        above = cap < F.lit(unit) * F.col("weight")
        held, open_weight, n = per.agg(
            F.sum(F.when(above, cap).otherwise(0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.sum(above.cast("long"))
        ).first()
        if not open_weight or n == stopped:
            break
        stopped, unit = n, (total - held) / open_weight
    out = durable(per.withColumn("target", F.least(cap.cast("double"), F.lit(unit) * F.col("weight"))).drop("weight"), "targets")
    forget(per)
    return out


def plan(docs: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, most: int = MOST) -> DataFrame:
    """documents -> (doc_id, source, row_hash, nth, size, source_size, target, taken, copies), one row per
    document. copies: array of (position, words), one for each copy that the mix takes; all hold the
    document's whole size but for the last copy of one document of a source at most, so a source's
    taken words miss its target by less than one.

    Null texts have size 0 and are never taken; null sources are one source, last; rows that repeat every
    column take consecutive places (nth tells them apart); an empty table gives an empty result; extra
    columns only enter row_hash. The order depends on the rows' values alone, so reruns agree."""
    narrow = durable(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), row_hash(docs),
        n_words(F.col("text").cast("string")).alias("size"),
    ).select(
        "*", F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source")).alias("s"),
        F.xxhash64(F.lit(7), "doc_id", "row_hash").alias("key"),
    ).withColumn("bucket", F.pmod("key", F.lit(BUCKETS))), "sizes")
    to = _targets(narrow, weights, slopes, most)
    by_bucket = narrow.groupBy("s", "bucket").agg(F.sum("size").alias("b"))
    before = by_bucket.withColumn("before", F.sum("b").over(Window.partitionBy("s").orderBy("bucket")) - F.col("b")).drop("b")
    order = Window.partitionBy("s", "bucket").orderBy("key", "doc_id", "row_hash")
    placed = narrow.withColumn("run", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.withColumn("nth", F.row_number().over(Window.partitionBy("s", "bucket", "key", "doc_id", "row_hash").orderBy("run")))
    out = placed.join(before, ["s", "bucket"]).join(to, "s").withColumn("start", F.col("run") + F.col("before"))
    whole = F.floor("target")
    out = out.withColumn("full", F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long"))
    rest = whole - F.col("full") * F.col("source_size")
    out = out.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start"))).cast("long"))
    linear, square = (float(x or 0) for x in to.agg(F.sum(F.col("target") * (1 - F.col("slope"))), F.sum(F.col("target") * F.col("slope"))).first())

    def copy(p: Column) -> Column:
        x = F.least(F.lit(1.0), (p * F.col("source_size") + F.col("start")) / F.col("target"))
        b = 1 - F.col("slope")
        t = F.when(x == 0, 0.0).otherwise(2 * x / (b + F.sqrt(b * b + 4 * F.col("slope") * x)))
        return F.struct(
            (F.lit(linear) * t + F.lit(square) * t * t).alias("position"),
            F.when(p < F.col("full"), F.col("size")).otherwise(F.col("part")).alias("words"),
        )

    n = F.when(F.col("size") > 0, F.col("full") + (F.col("part") > 0).cast("long")).otherwise(0)
    copies = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(most).cast("long")), lambda p: p < n), copy)
    out = durable(out.select(
        "doc_id", "source", "row_hash", "nth", "size", "source_size", "target",
        (F.col("full") * F.col("size") + F.col("part")).alias("taken"), copies.alias("copies"),
    ), "plan")
    forget(narrow, to)
    return out


def range_sorted(df: DataFrame, total: float, *ties: str) -> DataFrame:
    """Rows in order of position, those without one first. Positions spread over [0, total] as the words
    do, so equal ranges of them are the partitions; nothing need be sampled."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.floor(F.coalesce("position", F.pmod(F.xxhash64(*ties), F.lit(1000)) / 1000 * total) * n / max(total, 1.0))
    return df.repartitionById(n, F.least(F.lit(n - 1), F.greatest(F.lit(0), at)).cast("int")).sortWithinPartitions("position", *ties)


def mix(docs: DataFrame, **how) -> DataFrame:
    """The plan in training order, by each document's first copy; documents that are not taken have no
    position."""
    out = plan(docs, **how).withColumn("position", F.get("copies", F.lit(0))["position"])
    total = out.agg(F.sum("taken")).first()[0] or 0
    return range_sorted(out, float(total), "doc_id")


def mixed_documents(docs: DataFrame, whole: bool = False, **how) -> DataFrame:
    """The training stream: docs' columns, one row for each copy that is taken, in order of position. A
    copy that is taken in part holds its first words, joined by single spaces; if whole, it is taken with
    its whole text where that is nearer the target, else left."""
    cols = list(docs.columns)
    own = plan(docs, **how).filter("taken > 0").select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_h"), F.col("nth").alias("_nth"), "taken", "size", "copies")
    total = own.agg(F.sum("taken")).first()[0] or 0
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    rows = docs.select(packed(docs), key.alias("_key"), row_hash(docs).alias("_h"))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_key", "_h").orderBy(F.lit(1))))
    own = own.withColumn("_key", F.coalesce("_id", F.lit(0))).select("_key", "_h", "_nth", "size", "copies")
    out = rows.join(own, ["_key", "_h", "_nth"]).select("_row", "_key", "size", F.explode("copies").alias("_copy"))
    text = F.col("_row.text").cast("string")
    if whole:
        out = out.filter(F.col("_copy.words") * 2 >= F.col("size")).withColumn("_copy", F.col("_copy").withField("words", F.col("size")))
    cut = _first_words(text, F.col("_copy.words"))
    out = out.select("_row", "_key", F.col("_copy.position").alias("position"), F.when(F.col("_copy.words") < F.col("size"), cut).otherwise(text).alias("_text"))
    out = range_sorted(out, float(total), "_key")
    return out.select(*[F.col("_text").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in cols])


def _first_words(text: Column, n: Column) -> Column:
    """The text's first n words, joined by single spaces."""
    return F.array_join(F.slice(words(text), 1, n.cast("int")), " ")
