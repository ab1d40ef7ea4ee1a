"""Joins that a plain equality doesn't say: as-of, longest prefix, containment, candidates, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ancestors


def asof_last(left: DataFrame, right: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """left plus value: that of right's latest row of the same key with a smaller order. One sort of both
    sides by key; equal orders don't see each other."""
    a = left.withColumn("_value", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("_left", F.lit(True))
    b = right.select(key, order, F.col(value).alias("_value")).withColumn("_left", F.lit(False))
    both = a.unionByName(b, allowMissingColumns=True)
    # rows of one order are peers: left rows sort before right ones and look back over whole rows
    before = Window.partitionBy(key).orderBy(order, F.col("_left").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(before)).filter("_left").drop("_value", "_left")


def longest_prefix(paths: DataFrame, path: str, owners: DataFrame, prefix: str, owner: str) -> DataFrame:
    """paths plus prefix and owner of the deepest directory in owners that holds the path: the path's
    ancestors are listed and joined by equality, so no pair of strings is compared by length."""
    own = owners.groupBy(F.col(prefix).alias("_dir")).agg(F.min(owner).alias("_owner"))
    listed = paths.withColumn("_dir", F.explode(ancestors(F.col(path))))
    best = listed.join(own, "_dir").groupBy(path).agg(F.max_by(F.struct("_dir", "_owner"), F.length("_dir")).alias("_best"))
    return paths.join(best, path, "left").select("*", F.col("_best._dir").alias(prefix), F.col("_best._owner").alias(owner)).drop("_best")


def contained_in(points: DataFrame, point: str, spans: DataFrame, start: str, end: str, name: str, step: int) -> DataFrame:
    """points plus name of the smallest span (start <= point < end) that holds it, the least name of equal ones. Each span
    is cut at borders of blocks about as long as it is, so that within a block a piece reaches from or up to the block's
    border, and running minima in both directions answer every distinct point: the work grows with the rows, not with the
    pairs that meet. Blocks are no longer than `step` (rounded up to a power of two): of longer spans the inner blocks are
    spans over the blocks' numbers. Both tables are read several times."""
    types = [dict(points.dtypes)[point], dict(spans.dtypes)[start], dict(spans.dtypes)[end]]
    whole = not {"double", "float"} & set(types)
    digits = max(int(t[:-1].split(",")[1]) if t.startswith("decimal") else 0 for t in types) if whole else 0

    def number(c: str, most: float = float("nan")) -> Column:
        """Whole numbers (decimals by their last place), or doubles; not a number is null."""
        if whole:
            return (F.col(c).cast(f"decimal(18,{digits})") * F.lit(10**digits) if digits else F.col(c)).cast("bigint")
        x = F.col(c).cast("double")
        x = F.when(F.abs(x) < most, x)  # nan is more than infinity
        return F.when(F.abs(x) >= 2.0**62, F.raise_error(F.lit(f"{c} is 2^62 or more"))).otherwise(x)

    here = number(point, float("inf"))  # no span holds an infinite point
    at = points.select(here.alias("_at")).filter("_at IS NOT NULL")
    given = spans.select(number(start).alias("_start"), number(end).alias("_end"), F.col(name).alias("_name")).filter("_start < _end")
    best = _smallest(at, given, whole, min((step * 10**digits - 1).bit_length(), 62))
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in points.columns])
    held = points.select(row.alias("_row"), here.alias("_point")).join(best, F.col("_point") == F.col("_at"), "left")
    return held.select(*[F.col("_row")[c].alias(c) for c in points.columns], F.col("_best.name").alias(name))


def _smallest(at: DataFrame, spans: DataFrame, whole: bool, top: int | None) -> DataFrame:
    """(_at, _best): the least (width, name) of the spans (_start, _end, _name) that hold each of the points that any
    holds. A span's level is a power of two no longer than it, so its ends lie in different blocks; from `top` on, spans
    give their ends to blocks of that level and the blocks between them, with the span's _width, to a round without top."""

    def block(x: Column, level: Column) -> Column:
        return F.call_function("shiftright", x, level) if whole else F.floor(x / F.pow(F.lit(2.0), level))

    length = F.col("_end") - F.col("_start")
    level = F.length(F.bin(length)) - 1 if whole else F.floor(F.log2(length)).cast("int") - 1
    level, width = (level, F.col("_width")) if top is None else (F.least(level, F.lit(top)), length)
    once = spans.groupBy(*[c for c in spans.columns if c != "_name"]).agg(F.min("_name").alias("_name")).withColumn("_level", level)
    spans = spans.withColumn("_level", level)
    first, last = block(F.col("_start"), F.col("_level")), block(F.col("_end"), F.col("_level"))
    touched = F.sequence(first, last)
    if top is not None:
        touched = F.when(F.col("_level") == top, F.array(first, last)).otherwise(touched)
    best = F.struct(width.alias("width"), F.col("_name").isNull().alias("unnamed"), F.col("_name").alias("name"))
    pieces = once.select("_level", F.explode(touched).alias("_block"), "_start", "_end", last.alias("_last"), best.alias("_best"))
    opens = F.col("_block") < F.col("_last")
    rows = pieces.select("_level", "_block", F.when(opens, F.col("_start")).otherwise(F.col("_end")).alias("_at"), F.when(opens, 1).otherwise(2).alias("_kind"), "_best")
    if top is not None:
        inner = spans.filter((F.col("_level") == top) & (first + 1 < last)).select((first + 1).alias("_start"), last.alias("_end"), width.alias("_width"), "_name")
        through = _smallest(at.select(block(F.col("_at"), F.lit(top)).alias("_at")), inner, True, None)
        border = F.col("_at") * F.lit(1 << top)
        rows = rows.unionByName(through.select(F.lit(top).alias("_level"), F.col("_at").alias("_block"), (border if whole else border.cast("double")).alias("_at"), F.lit(1).alias("_kind"), "_best"))
    levels = F.broadcast(spans.select("_level").distinct())  # 64 at most
    asked = at.distinct().crossJoin(levels).select("_level", block(F.col("_at"), F.col("_level")).alias("_block"), "_at", F.lit(0).alias("_kind"))
    rows = rows.unionByName(asked, allowMissingColumns=True)
    here = Window.partitionBy("_level", "_block")
    # a piece from its start on counts at that point already, one up to its end no longer
    from_ = F.min(F.when(F.col("_kind") == 1, F.col("_best"))).over(here.orderBy("_at", F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0))
    until = F.min(F.when(F.col("_kind") == 2, F.col("_best"))).over(here.orderBy(F.desc("_at"), "_kind").rowsBetween(Window.unboundedPreceding, 0))
    found = rows.select("_at", "_kind", F.least(from_, until).alias("_best")).filter("_kind = 0 AND _best IS NOT NULL")
    return found.groupBy("_at").agg(F.min("_best").alias("_best"))


def candidates(calls: DataFrame, call: str, keys: Column, targets: DataFrame, key: str, target: str) -> DataFrame:
    """(call, targets, resolution) over each call's list of candidate keys: Resolved for one target,
    CandidateTargets for more, Unresolved for none."""
    listed = calls.select(call, F.explode_outer(keys).alias("_key"))
    named = targets.select(F.col(key).alias("_key"), F.col(target).alias("_target"))
    grouped = listed.join(named, "_key", "left").groupBy(call).agg(F.array_sort(F.collect_set("_target")).alias("targets"))
    return grouped.withColumn("resolution", resolution(F.size("targets")))


def resolution(n: Column) -> Column:
    return F.when(n == 1, "Resolved").when(n > 1, "CandidateTargets").otherwise("Unresolved")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of child whose non-null key no parent has."""
    keys = parent.select(F.col(parent_key).alias(key)).distinct()
    return child.filter(F.col(key).isNotNull()).join(keys, key, "left_anti").select(*child.columns)


def differences(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, state): a full outer merge; state is added, removed, changed or same."""
    a = old.select(key, F.col(value).alias("before"), F.lit(True).alias("_a"))
    b = new.select(key, F.col(value).alias("after"), F.lit(True).alias("_b"))
    state = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").withColumn("state", state).drop("_a", "_b")
