"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, source mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamgraph.llm.common import durable, forget
from seamgraph.llm.linededup import MIN_WORDS, line_dedup
from seamgraph.llm.mixing import mixed_documents
from seamgraph.llm.pieces import encode_decode
from seamgraph.llm.quality import quality_filter
from seamgraph.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their group's fences reject go."""
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of line runs, long ones of one or two lines too, leave the texts; n_chars follows.
    Documents that lose every line stay, empty."""
    out = line_dedup(docs, min_words=MIN_WORDS)
    if "n_chars" in docs.columns:
        cut = F.col("n_removed") > 0
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the least doc_id stays."""
    return keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy of a document that the mix takes, in training order; texts stay whole."""
    return mixed_documents(docs, whole=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and what they decode to."""
    out = encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_dups),
    ("source mixing", mixture),
    ("SentencePiece", tokens),
]

#: SQL can't express SimHash or the encoding; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = durable(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        forget(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
