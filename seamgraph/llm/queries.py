"""The subpackage's registered queries: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable
from secrets import token_hex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_table


#: The public vocabulary file that op9 encodes with; the installed package knows its place.
VOCABULARY = "piece_bpe_32k.model"


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import BASE, listed, secret_scan

    out = secret_scan(docs_table(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(docs_table(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import substring_dedup

    out = substring_dedup(docs_table(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .covertree import embedding_near_dups

    return embedding_near_dups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cotrain import cotrain

    return cotrain(docs_table(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import MIN_WORDS, line_dedup

    out = line_dedup(docs_table(spark, sf_dir), min_words=MIN_WORDS)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(docs_table(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "position")


#: Where a deployment keeps the key of the pseudonyms; Spark hides settings of such a name in its logs.
PII_SETTING = "spark.seamgraph.pii.secret"


def _pii_key(spark: SparkSession) -> str:
    """The session's key; where none is set, a random one that lasts as long as the session."""
    key = spark.conf.get(PII_SETTING, None)
    if not key:
        key = token_hex(32)
        spark.conf.set(PII_SETTING, key)
    return key


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import PATTERNS, pseudonymize

    out = pseudonymize(docs_table(spark, sf_dir), _pii_key(spark))
    count = lambda kind: F.size(F.filter("finds", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in PATTERNS], "text")


def op9_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_decode

    out = encode_decode(docs_table(spark, sf_dir), _vocabulary())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex16, simhash_near_dups

    out = simhash_near_dups(docs_table(spark, sf_dir))
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_quality_rules": op2_quality_rules,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_embedding_near_dedup": op4_embedding_near_dedup,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_line_dedup": op6_line_dedup,
        "op7_source_mixing": op7_source_mixing,
        "op8_pii_pseudonyms": op8_pii_pseudonyms,
        "op9_sentencepiece_round_trip": op9_sentencepiece_round_trip,
        "op10_simhash_near_dedup": op10_simhash_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.SQL
