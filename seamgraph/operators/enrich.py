"""Compiler observations as graph edges. No compiler runs here: observations come as rows or JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OBSERVATION = "file string, kind string, start int, category string, targets array<struct<file:string,start:int,`end`:int>>"


def observations(lines: DataFrame, column: str = "value", refuse: bool = True) -> DataFrame:
    """Typed observations from JSON lines. A line of another shape fails the query; with refuse=False it is left out."""
    read = lines.select(F.from_json(F.col(column), OBSERVATION).alias("o"))
    whole = F.coalesce(*[F.when(F.col(f"o.{c}").isNull(), F.lit(False)) for c in ("file", "kind", "start", "targets")], F.lit(True))
    whole = whole & F.coalesce(F.forall("o.targets", lambda t: t["file"].isNotNull() & t["start"].isNotNull() & t["end"].isNotNull()), F.lit(False))
    if refuse:
        return read.select(F.when(whole, F.col("o")).otherwise(F.raise_error(F.lit("InvalidEvidence: an observation of another shape")).cast(read.schema["o"].dataType)).alias("o")).select("o.*")
    return read.filter(whole).select("o.*")


def located(found: DataFrame, symbols: DataFrame, most: int | None = None) -> DataFrame:
    """Observed target ranges as declarations: those of the file that end where the range ends, start in it and
    are functions or methods. The end is an equality, so the join is one shuffle. With most, a file with more targets than
    that fails the query."""
    one = found.select("file", "kind", "start", F.explode("targets").alias("t"))
    s = symbols.filter(F.col("kind").isin("Function", "Method")).select(
        F.col("file").alias("s_file"), F.col("start").alias("s_start"), F.col("end").alias("s_end"), F.col("id").alias("target")
    )
    hit = one.join(s, (F.col("t.file") == F.col("s_file")) & (F.col("t.end") == F.col("s_end")) & (F.col("s_start") >= F.col("t.start")))
    at = hit.groupBy("file", "kind", "start").agg(F.array_sort(F.collect_set("target")).alias("compiler_targets"))
    if most is None:
        return at
    over = at.groupBy("file").agg(F.sum(F.size("compiler_targets")).alias("_n"))
    kept = F.when(F.col("_n") <= most, F.col("compiler_targets")).otherwise(F.raise_error(F.lit("ResourceLimitExceeded: compiler targets")).cast("array<string>"))
    return at.join(over, "file").select("file", "kind", "start", kept.alias("compiler_targets"))


def projected_id(source: Column, file: Column, kind: Column, start: Column, target: Column) -> Column:
    quoted = [F.concat(F.lit('"'), c, F.lit('"')) for c in (source, file, kind)]
    parts = [*quoted, start.cast("string"), F.concat(F.lit('"'), target, F.lit('"')), F.lit('"compiler_projection"')]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)


def project_targets(edges: DataFrame, found: DataFrame) -> DataFrame:
    """edges plus a CandidateTargets edge for each observed target that an edge doesn't have already."""
    seen = edges.join(found, ["file", "kind", "start"]).select(*edges.columns, F.explode("compiler_targets").alias("_t"))
    extra = seen.filter(~F.col("target").eqNullSafe(F.col("_t"))).withColumn("id", projected_id(*[F.col(c) for c in ("source", "file", "kind", "start", "_t")]))
    extra = extra.withColumn("target", F.col("_t")).withColumn("resolution", F.lit("CandidateTargets")).drop("_t").dropDuplicates(["id"])
    return edges.withColumn("basis", F.lit(None).cast("string")).unionByName(extra.withColumn("basis", F.lit("compiler_projection")))
