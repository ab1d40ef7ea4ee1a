"""Shared helpers: shared-folder tables, words, span arithmetic."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: code points that are not space, tab, newline, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and one machine does all the work."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='seamgraph-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors. What is not
    forgotten before goes when the application ends."""
    spark = df.sparkSession
    home = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    at = f"{home}/{name}-{uuid.uuid4().hex}"
    if spark.conf.get(_CLEANUP, "false") != "true":
        spark.conf.set(_CLEANUP, "true")  # a table that is written is whole: its shuffle files serve nothing more
    df.write.option("compression", "zstd").parquet(at)
    path, fs = _path(spark, home)
    fs.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(at)
    out._seam_path = at
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that durable() wrote and that nothing reads any more."""
    for df in tables:
        at = getattr(df, "_seam_path", None)
        if at:
            path, fs = _path(df.sparkSession, at)
            fs.delete(path, True)


#: A key with more than one in HOT of all rows is hot; there are fewer than HOT such keys.
HOT = 2000


def met(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right, which holds each of left's keys once at most, with its number of left's rows in
    `count`. The keys that hold more than one in HOT of the total rows, fewer than HOT of them by their sum,
    travel to left's rows; the others are shuffled, so no task gets many rows of one key. how: inner or left."""
    limit = total // HOT + 1
    hot = F.broadcast(right.filter(F.col(count) > limit))
    cold = right.filter(F.col(count) <= limit)
    rest = left.join(F.broadcast(right.filter(F.col(count) > limit).select(*keys)), keys, "left_anti")
    # cold keys grow with the input, so they are shuffled at every size
    return left.join(hot, keys).drop(count).unionByName(rest.join(cold.hint("merge"), keys, how).drop(count))


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; those that hold a map, which can't be hashed, enter as JSON."""

    def has_map(kind) -> bool:
        inner = [f.dataType for f in kind.fields] if kind.typeName() == "struct" else [kind.elementType] if kind.typeName() == "array" else []
        return kind.typeName() in ("map", "variant") or any(map(has_map, inner))

    at = lambda f: F.col(f"`{f.name}`")
    return F.xxhash64(*[F.to_json(F.struct(at(f).alias("x"))) if has_map(f.dataType) else at(f) for f in docs.schema.fields]).alias("row_hash")


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda over a one-element array binds it."""
    return F.transform(F.array(value), body)[0]


def packed(df: DataFrame, cols: list[str] | None = None) -> Column:
    """df's columns as one struct, so that their names can't clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in (df.columns if cols is None else cols)]).alias("_row")


def spans(text: Column, pattern: str, group: int | None = None) -> Column:
    """All matches of pattern, leftmost and not overlapping, as array of (start, end, found[, part]): code
    points, end exclusive; part is the group's text. The pattern must not match the empty string."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group if group is not None else 0))
    steps = F.filter(F.arrays_zip(found.alias("found"), gaps.alias("gap"), parts.alias("part")), lambda x: x["found"].isNotNull())
    kind = "array<struct<start:int,end:int,found:string,part:string>>"
    width = lambda x: F.length(x["gap"]) + F.length(x["found"])

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + width(x)
        one = F.struct((end - F.length(x["found"])).alias("start"), end.alias("end"), x["found"].alias("found"), x["part"].alias("part"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one).cast(kind)).alias("out"))

    def walk(all_steps: Column) -> Column:
        # an array that grows copies itself at every step, so the steps go in blocks of about the root of their number
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(all_steps)))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(all_steps) / size).cast("int") - 1), lambda k: F.slice(all_steps, k * size + 1, size))
        add = lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(b, F.lit(0), lambda n, x: n + width(x))))

        def placed(bs: Column) -> Column:
            starts = F.aggregate(bs, F.array(F.lit(0)), add)
            inner = lambda at: lambda b, k: F.aggregate(b, F.struct(at[k].alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])
            return let(starts, lambda at: F.flatten(F.transform(bs, inner(at))))

        return let(blocks, placed)

    return F.when(F.regexp_like(text, F.lit(pattern)), let(steps, walk)).otherwise(F.array().cast(kind))


def docs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
