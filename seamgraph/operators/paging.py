"""Bounded results: overflow that raises, keyset pages, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Overflow(RuntimeError):
    """A query matched more rows than its bound: it is never cut silently."""


def at_most(df: DataFrame, n: int, *order: str) -> list:
    """All rows in order, or Overflow if there are more than n: one more row is asked for, so that the
    engine stops early."""
    rows = df.orderBy(*order).limit(n + 1).collect()
    if len(rows) > n:
        raise Overflow(f"more than {n} rows match")
    return rows


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next `size` rows by key after a cursor; the filter reaches the scan."""
    return (df if after is None else df.filter(F.col(key) > F.lit(after))).orderBy(key).limit(size)


def budget_page(df: DataFrame, group: str, order: str, cost: str, start: int, cap: int, budget: int) -> DataFrame:
    """Of each group rows start .. start + cap - 1 by order, as far as their running cost stays in budget. The rank's
    bound is one that the engine knows, so no group is sorted whole: each task keeps its first start + cap rows."""
    place = Window.partitionBy(group).orderBy(order)
    page = df.withColumn("_rank", F.row_number().over(place)).filter(F.col("_rank") <= start + cap).filter(F.col("_rank") > start)
    page = page.withColumn("position", F.col("_rank") - 1).drop("_rank")
    return page.withColumn("spent", F.sum(cost).over(place.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("spent") <= budget)


def text_pages(df: DataFrame, text: str, size: int) -> DataFrame:
    """df's rows once for each page of their text: offset_bytes, page and slice_complete. A page holds at most `size` bytes
    (4 or more) of UTF-8 and never a part of a character, so the pages in order make up the whole text. Null texts have
    no page, empty ones one. Pages begin at the characters that hold every (size - 3)rd byte, so each page is cut by
    itself, whatever stands before it."""
    if size < 4:
        raise ValueError("a page holds at least one character")
    stride = size - 3
    rows = df.filter(F.col(text).isNotNull()).withColumn("_raw", F.encode(F.col(text), "UTF-8")).withColumn("_n", F.octet_length(F.col(text)))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("_n") / stride).cast("int") - 1))).alias("_k"))

    def start_of(at: Column) -> Column:
        """The start of the character that holds byte `at`: at most three bytes before."""
        leads = lambda k: F.conv(F.hex(F.substring("_raw", at + 1 - k, F.lit(1))), 16, 10).cast("int").bitwiseAND(F.lit(0xC0)) != 0x80
        return F.when((at <= 0) | (at >= F.col("_n")), F.least(at, F.col("_n"))).when(leads(0), at).when(leads(1), at - 1).when(leads(2), at - 2).otherwise(at - 3)

    rows = rows.withColumn("offset_bytes", start_of(F.col("_k") * stride)).withColumn("_end", start_of((F.col("_k") + 1) * stride))
    page = F.decode(F.substring("_raw", F.col("offset_bytes") + 1, F.col("_end") - F.col("offset_bytes")), "UTF-8")
    return rows.withColumn("page", page).withColumn("slice_complete", F.col("_end") == F.col("_n")).drop("_raw", "_n", "_k", "_end")


def occurrence(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The ordinal of each row among those of equal keys."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
