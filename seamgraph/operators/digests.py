"""Identities and state digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ref(kind: str, *identity: Column) -> Column:
    """A typed reference: the hash of the canonical JSON list of its kind and identity strings."""
    return F.sha2(F.to_json(F.array(F.lit(kind), *identity)), 256)


def row_digest(*cols: str) -> Column:
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def state_root(df: DataFrame, row: Column, bucket: Column) -> DataFrame:
    """(root): rows hash into buckets' sorted lists, buckets into one root. A bucket is one task's list, so
    choose as many as the table needs; the root depends on rows and buckets alone, not on their order."""
    leaves = df.select(bucket.alias("bucket"), row.alias("h")).groupBy("bucket").agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h")
    )
    return leaves.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), ""), 256).alias("root"))
