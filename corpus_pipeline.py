"""A training corpus from documents: quality rules, near-duplicates, secrets, source mixing, token ids.

Every stage works on all rows of its predecessor, whatever their doc_ids: nulls, repeats and equal rows are rows like any
other. An empty table stays empty. Columns beyond those of documents pass through all stages.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm import bpe, mixing, near_dup, quality, secret_scan
from murmur.llm.common import discard, tidied, unused


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail a fixed rule or are outliers of their language and source go; a null text has no words and goes."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts stays, and every row without doc_id."""
    return near_dup.deduplicate(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every row stays."""
    return secret_scan.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies by source rate, in shuffled order; a row drawn zero times goes."""
    copy, key = unused(docs, "copy", "shuffle_key")
    return mixing.replicate(docs, copy=copy, shuffle_key=key).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the SHA-256 of the bytes that they decode to."""
    coded = bpe.decode(bpe.encode(docs))
    return coded.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", source_mixing),
    ("byte-level BPE encoding and decoding", token_ids),
]

#: Several stages (outlier estimates, signatures, merges of byte pairs) are beyond SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        done = tidied(spark, name.replace(" ", "-"), functools.partial(stage, spark, docs, sf_dir))
        if i:
            discard(docs)
        docs = done
    return docs
