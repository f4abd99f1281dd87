"""A corpus pipeline: toxicity, near duplicates, repeated passages, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``documents``. Empty tables pass through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import bpe, mixing, ngram_join, suffix_dedup, toxicity
from tidewheel.operators.components import checkpointed

#: Documents that score this or more are rejected.
TOXIC = 0.7


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that a model of the labels finds toxic; learns from the rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(toxicity.fold("doc_id") != 1)
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs, model).filter(F.col("score") < TOXIC).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each component of near duplicates (five words, 0.8)."""
    found = ngram_join.jaccard_components(docs, n=5, percent=80)
    drop = checkpointed(found.filter("component_id <> id").select(F.col("id").alias("doc_id")).distinct())
    small = drop.count() <= ngram_join.BROADCAST_IDS
    return docs.join(F.broadcast(drop) if small else drop, "doc_id", "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove strings of 50 bytes that an earlier document has; what a cut leaves of a character goes too."""
    kept = suffix_dedup.remove_repeats(docs, width=50, as_text=True)
    text = F.when(F.size("spans") > 0, F.col("kept")).otherwise(F.col("text"))
    return kept.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicate sources to square-root weights and shuffle."""
    return mixing.mix(docs).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, beside the digest of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(docs.select("doc_id", "source", "text"), path, public_tokenizers.PATTERN, digest_column="decoded_sha256")
    return ids.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded_sha256")


STAGES = [
    ("toxicity", toxic),
    ("ngram_jaccard", near_duplicates),
    ("suffix_array", repeated_passages),
    ("mixing", mixed),
    ("byte_bpe", tokens),
]

#: Fitting, component search and tokenising are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is cut from its lineage in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
