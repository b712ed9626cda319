"""Corpus pipeline: toxic documents go, one of each group of near copies stays, benchmark text goes,
secrets are masked, and what is left is packed into length buckets.

Every stage takes (spark, docs, sf_dir) and works on what the stage before has kept; its result is
written as Parquet before the next one reads it. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcast.llm import decontaminate, ngram_join, packing, secrets, toxicity
from fleetcast.llm.frames import free_name
from fleetcast.session import stage

TOXIC_FROM = 0.7
VOCABULARY = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC_FROM``; a third of the labels is never learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out(F.col("doc_id")))
    name = free_name(docs, "toxicity")
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, labels), result=name)
    return scored.filter(F.col(name).score < TOXIC_FROM).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles link it at a similarity of 0.8 or more."""
    return ngram_join.drop_near_duplicates(docs)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind; a column n_chars follows the text."""
    masked = secrets.mask_secrets(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_buckets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every chunk of every document; lengths are tokens."""
    return packing.pack(docs, packing.token_count(F.col("text"), public_tokenizers.path(VOCABULARY)), tie=F.xxhash64("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_benchmark_text),
    ("secret_scan", mask_secret_spans),
    ("packing", pack_buckets),
]

#: scores and exact joins of whole texts are beyond SQL; the tests hold ``run`` against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
